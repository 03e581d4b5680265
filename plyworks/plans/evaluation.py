"""Evaluation sets and the metrics of models, matches and training runs. Model outputs come in as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import text as tx
from ..operators import aggregates as agg
from ..operators import joins
from ..operators import sequences as seq

Bands = list[tuple[float, float, str]]


def eval_games(games: DataFrame, bands: Bands, *, event: str = "Rated Blitz game") -> DataFrame:
    """Finished games of one event with both ratings, an increment time control and a player inside a band.

    Needs the columns of `with_headers`; all of it is settled before a game is replayed.
    """
    control = tx.is_increment_control(F.try_element_at("headers", F.lit("TimeControl")))
    g = games.filter((F.col("event") == event) & tx.result_label(F.col("result")).isNotNull() & control)
    g = g.filter("white_elo is not null and black_elo is not null")
    g = joins.in_band(joins.in_band(g, "white_elo", bands, "white_band"), "black_elo", bands, "black_band")
    return g.filter("white_band is not null or black_band is not null")


def eval_records(plies: DataFrame, bands: Bands, *, skip_plies: int = 10, min_plies: int = 20, game_id: str = "game_id") -> DataFrame:
    """A row per move to predict: the position, both clocks before the move, the moves so far, the mover's band and result."""
    whole = Window.partitionBy(game_id)
    before = whole.orderBy("ply").rowsBetween(Window.unboundedPreceding, -1)
    p = plies.withColumn("__n", F.count(F.lit(1)).over(whole)).filter(F.col("__n") >= min_plies).drop("__n")
    for side, out in (("w", "white_clock"), ("b", "black_clock")):
        known = F.last(F.when(F.col("side") == side, F.col("clk")), ignorenulls=True).over(before)
        p = p.withColumn(out, F.coalesce(known, F.col("initial_time")))
    p = p.withColumn("move_history", F.collect_list("uci").over(before))
    white = F.col("side") == "w"
    p = p.withColumn("elo_self", F.when(white, F.col("white_elo")).otherwise(F.col("black_elo")))
    p = p.withColumn("elo_oppo", F.when(white, F.col("black_elo")).otherwise(F.col("white_elo")))
    p = joins.in_band(p, "elo_self", bands, "elo_band").filter((F.col("ply") > skip_plies) & F.col("elo_band").isNotNull())
    return p.select(
        game_id, "ply", F.col("fen_before").alias("fen"), F.col("uci").alias("played_move"), "side", "elo_self", "elo_oppo", "white_elo", "black_elo",
        "white_clock", "black_clock", "increment", "move_history", "elo_band", tx.result_for_side(F.col("result"), F.col("side")).alias("result_for_side"),
    )


def balanced_set(records: DataFrame, per_band: int, game_id: str = "game_id") -> DataFrame:
    """The first `per_band` records of each band, in order of game and ply."""
    return seq.first_of_each(records, "elo_band", [game_id, "ply"], per_band)


def played_rank(probabilities: Column, played: Column) -> Column:
    """1 + the number of moves that are likelier than the one played; null if the map lacks it. Ties share a rank."""
    own = F.try_element_at(probabilities, played)
    likelier = F.size(F.filter(F.map_values(probabilities), lambda p: p > own)) + 1
    return F.when(own.isNotNull(), likelier)


def move_metrics(predictions: DataFrame, *keys: str, probabilities: str = "probs", played: str = "played_move") -> DataFrame:
    """Rows and top-1, top-3 and top-5 accuracy, of all rows or by key; a played move that has no probability counts as missed."""
    rank = predictions.withColumn("__r", played_rank(F.col(probabilities), F.col(played)))
    hit = lambda k: F.avg(F.coalesce(F.col("__r") <= k, F.lit(False)).cast("double")).alias(f"top{k}")
    return rank.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), hit(1), hit(3), hit(5))


def outcome_metrics(predictions: DataFrame, *keys: str, p: str = "p", outcome: str = "result_for_side") -> DataFrame:
    """Rows, squared error and log-loss of expected scores; a draw is an outcome of one half."""
    q, y = F.col(p), F.col(outcome)
    return predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((q - y) * (q - y)).alias("brier"), F.avg(agg.log_loss(q, y)).alias("log_loss"))


def both_scored(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Rows of `a` for which `b` has a prediction too."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_semi")


def distribution_gaps(a: DataFrame, b: DataFrame, key: str, probabilities: str = "probs") -> DataFrame:
    """key, gap and the two distributions (`left`, `right`) of rows in both: the sum of absolute differences over all moves of either."""
    left, right = a.select(key, F.col(probabilities).alias("left")), b.select(key, F.col(probabilities).alias("right"))
    both = left.join(right, key)
    at = lambda m, k: F.coalesce(F.try_element_at(F.col(m), k), F.lit(0.0))
    moves = F.array_sort(F.array_union(F.map_keys("left"), F.map_keys("right")))
    gap = F.aggregate(F.transform(moves, lambda k: F.abs(at("left", k) - at("right", k))), F.lit(0.0), lambda s, x: s + x)
    return both.select(key, gap.alias("gap"), "left", "right")


def gap_summary(gaps: DataFrame, *keys: str, gap: str = "gap") -> DataFrame:
    return gaps.groupBy(*keys).agg(F.count(gap).alias("n"), F.max(gap).alias("maximum"), F.min(gap).alias("minimum"), F.avg(gap).alias("mean"))


def masked_brier(logits: Column, mask: Column, target: Column) -> Column:
    """Squared error from the one-hot target of a softmax over the entries that the mask allows."""
    return num.brier(num.masked_softmax(logits, mask), target)


def class_accuracy(df: DataFrame, target: str, predicted: str, classes: list[int]) -> DataFrame:
    """One row: overall accuracy and, of each class, the share of rows rightly told to be in it or not."""
    y, p = F.col(target), F.col(predicted)
    each = [F.avg(((y == c) == (p == c)).cast("double")).alias(f"class_{str(c).replace('-', 'minus_')}") for c in classes]
    return df.agg(F.avg((y == p).cast("double")).alias("accuracy"), *each)


def clock_errors(df: DataFrame, predicted: str, time: str, bounds: list[float], tail_mean: float) -> DataFrame:
    """One row: mean absolute error of the predicted buckets' centres, and the share of right buckets."""
    b = F.array(*map(F.lit, bounds))
    error = F.abs(num.bucket_center(F.col(predicted), b, tail_mean) - F.col(time))
    return df.agg(F.avg(error).alias("mae"), F.avg((num.bucket_index(F.col(time), b) == F.col(predicted)).cast("double")).alias("accuracy"))


def loss_windows(df: DataFrame, step: str, loss: str, size: int) -> DataFrame:
    """Mean loss of each full or begun window of `size` steps (from 0 on)."""
    window = F.floor(F.col(step) / size).cast("long")
    return df.groupBy(window.alias("window")).agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("steps"))


def rolling_mean(df: DataFrame, run: str, step: str, value: str, n: int, out: str, **options) -> DataFrame:
    """Mean of the last n values of a run, this one included."""
    return seq.rolling_mean(df, run, [step], value, n, out, **options)


def move_quality(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by source, and of model moves the mean probabilities and rank, and how often the first or first three were chosen.

    Columns: source (model, common_moves, fallback), top_move_prob, chosen_move_prob, chosen_move_rank.
    """
    model = F.col("source") == "model"
    of = lambda name: F.when(model, F.col(name))
    within = lambda k: (100.0 * F.avg((of("chosen_move_rank") <= k).cast("double")))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("moves"), F.count_if(model).alias("model_moves"), F.count_if(F.col("source") == "common_moves").alias("common_moves"),
        F.count_if(F.col("source") == "fallback").alias("fallback_moves"), F.avg(of("top_move_prob")).alias("top_prob"), F.avg(of("chosen_move_prob")).alias("chosen_prob"),
        F.avg(of("chosen_move_rank")).alias("chosen_rank"), within(1).alias("top1_percent"), within(3).alias("top3_percent"),
    )


def match_summary(games: DataFrame, *keys: str, score: str = "score", length: str = "n_moves") -> DataFrame:
    """Games, wins, draws, losses and score (1, 0.5, 0) of the first player, and the games' lengths."""
    s, n = F.col(score), F.col(length)
    return games.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("games"), F.count_if(s == 1).alias("wins"), F.count_if(s == 0.5).alias("draws"), F.count_if(s == 0).alias("losses"),
        F.sum(s).alias("score"), (100.0 * F.avg(s)).alias("score_percent"), F.avg(n).alias("mean_length"), F.stddev_pop(n).alias("std_length"),
        F.min(n).alias("min_length"), F.max(n).alias("max_length"),
    )


def with_expectation(summary: DataFrame, first: str, second: str) -> DataFrame:
    """Adds the percentage that the first player's rating promises against the second's, and what was scored beyond it."""
    promised = 100.0 * num.elo_expected(F.col(first) - F.col(second))
    return summary.withColumn("expected_percent", promised).withColumn("beyond_percent", F.col("score_percent") - promised)


def ending_shares(games: DataFrame, ending: str = "termination") -> DataFrame:
    """How often games end in each way, with the percentage."""
    return agg.shares(games, ending).withColumn("percent", 100.0 * F.col("share")).drop("share")


def partition_sizes(df: DataFrame) -> DataFrame:
    """One row: rows of the fullest and emptiest of the frame's partitions that have any, and how many have."""
    per = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.max("n").alias("maximum"), F.min("n").alias("minimum"), F.count(F.lit(1)).alias("filled"))
