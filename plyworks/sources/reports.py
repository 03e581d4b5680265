"""Tables as lines of text: JSON lines, Markdown and annotated game text. Spark writes them, gzipped where asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.ordered import Scan, scan


def json_lines(df: DataFrame) -> DataFrame:
    """`value`: each row as compact JSON."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_lines(lines: DataFrame, path: str, *, compress: bool = True) -> None:
    """One text file per partition."""
    lines.select("value").write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def gap_report(gaps: DataFrame) -> DataFrame:
    """The rows of the CSV report on differences between two ratings' moves, as text.

    gaps: fen, history (array or null), low and high (ratings), gap, low_top and high_top (array<struct<move, p>>), in_low, in_high.
    """
    known = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "True").otherwise("False")
    return gaps.select(
        "fen", F.array_join(F.coalesce("history", F.array().cast("array<string>")), ",").alias("recent_moves"), F.concat_ws("-", F.col("low").cast("string"), F.col("high").cast("string")).alias("rating_pair"),
        F.format_string("%.6f", "gap").alias("total_variation_distance"), tx.moves_as_csv(F.col("low_top")).alias("top5_lower_rating"), tx.moves_as_csv(F.col("high_top")).alias("top5_higher_rating"),
        known("in_low").alias("in_lower_common_moves"), known("in_high").alias("in_higher_common_moves"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Rows with a header, one file per partition."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def grouped_clock_records(records: DataFrame, *, with_history: bool) -> DataFrame:
    """A row per position: its thinking times, clocks and ratings in one order, and their count.

    The file format keeps a position on one line. Positions are keyed with their last moves, or without.
    """
    key = tx.pipe_key(F.col("recent_moves"), F.col("fen")).alias("position_key") if with_history else tx.strip_counters(F.col("fen")).alias("fen")
    item = F.struct("thinking_time", "player_clock", "opponent_clock", "increment", "rating")
    name = "position_key" if with_history else "fen"
    per = records.select(key, item.alias("i")).groupBy(name).agg(F.array_sort(F.collect_list("i")).alias("i"), F.count(F.lit(1)).alias("count"))
    clocks = F.transform("i", lambda i: F.struct(i["player_clock"].alias("player_clock"), i["opponent_clock"].alias("opponent_clock"), i["increment"].alias("increment")))
    return per.select(name, F.col("i.thinking_time").alias("thinking_times"), clocks.alias("clock_states"), F.col("i.rating").alias("ratings"), "count")


def position_parts(records: DataFrame, *, with_history: bool, part_rows: int = 100_000, **options) -> DataFrame:
    """As `grouped_clock_records`, but a position with many observations has several rows: `part` (from 0) of `part_rows` observations each.

    Observations of a position are numbered in their order, by ranges where there are many (`ordered.scan`), so neither a task nor a row has
    more than a part of a position. Rows of a position, put one after the other by part, are its one row: see `merged_parts`."""
    key = tx.pipe_key(F.col("recent_moves"), F.col("fen")).alias("position_key") if with_history else tx.strip_counters(F.col("fen")).alias("fen")
    name, item = "position_key" if with_history else "fen", ["thinking_time", "player_clock", "opponent_clock", "increment", "rating"]
    numbered = scan(records.select(key, *item), [name], item, Scan("__n", "sum", F.lit(1)), **options)
    parts = numbered.withColumn("part", F.floor((F.col("__n") - 1) / part_rows).cast("int")).groupBy(name, "part")
    per = parts.agg(F.array_sort(F.collect_list(F.struct(*item))).alias("i"), F.count(F.lit(1)).alias("count"))
    clocks = F.transform("i", lambda i: F.struct(i["player_clock"].alias("player_clock"), i["opponent_clock"].alias("opponent_clock"), i["increment"].alias("increment")))
    return per.select(name, "part", F.col("i.thinking_time").alias("thinking_times"), clocks.alias("clock_states"), F.col("i.rating").alias("ratings"), "count")


def merged_parts(parts: DataFrame) -> DataFrame:
    """The one row of each position, from its parts in their order."""
    name = parts.columns[0]
    columns = ["thinking_times", "clock_states", "ratings"]
    per = parts.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("part", *columns))).alias("p"), F.sum("count").alias("count"))
    return per.select(name, *[F.flatten(F.col(f"p.{c}")).alias(c) for c in columns], "count")


def markdown_lines(df: DataFrame) -> DataFrame:
    """(line, value): a Markdown table of the rows, in order of the frame's columns; null is an empty cell."""
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\|", r"\\|"), F.lit("")) for c in df.columns]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(0, f"| {' | '.join(df.columns)} |"), (1, f"|{'---|' * len(df.columns)}")], "line int, value string")
    return head.unionByName(df.select(F.lit(2).alias("line"), row.alias("value"))).orderBy("line", "value")


def game_text(moves: DataFrame, headers: list[str], game_id: str = "game_id") -> DataFrame:
    """(game_id, pgn): header lines, then numbered moves with their clocks.

    moves: ply, san, clk (seconds, null if unknown), result and the header columns, which are named as in the text.
    """
    clock = F.when(F.col("clk").isNotNull(), F.concat(F.lit(" {[%clk "), tx.hms(F.col("clk")), F.lit("]}"))).otherwise("")
    number = F.when(F.col("ply") % 2 == 1, F.concat(F.floor((F.col("ply") + 1) / 2).cast("string"), F.lit(". "))).otherwise("")
    word = F.struct("ply", F.concat(number, "san", clock).alias("t"))
    names = {h.lower(): h for h in ["result", *headers]}  # the result may be a header too
    first = [F.first(h).alias(h) for h in names.values()]
    per = moves.groupBy(game_id).agg(F.array_sort(F.collect_list(word)).alias("w"), *first)
    lines = [F.concat(F.lit(f'[{h} "'), F.coalesce(F.regexp_replace(F.col(h).cast("string"), '(["\\\\])', r"\\$1"), F.lit("?")), F.lit('"]\n')) for h in headers]
    end = F.coalesce("result", F.lit("*"))
    return per.select(game_id, F.concat(*lines, F.lit("\n"), F.concat_ws(" ", F.col("w.t")), F.lit(" "), end, F.lit("\n")).alias("pgn"))
