"""From games to plies to training records. Header filters come before the replay, so dropped games are never replayed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.board import replay
from ..functions.registry import game_outcome
from ..operators import aggregates as agg
from ..operators import filters, joins
from ..operators import sequences as seq
from ..operators.ordered import Scan, scan

#: Plies that a game has at most by the rules (it is drawn before); so windows by game are bounded and games are not counted, which would replay them.
GAME_PLIES = 20_000

_PLY = T.StructType([T.StructField("ply", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("side", "san", "uci", "fen_before", "fen_after", "comment")]])


#: Games whose plies a task holds in Python at a time, however many games Spark hands over at once, and plies with which no further game is taken.
_AT_ONCE, _PLIES_AT_ONCE = 256, 8_192


def _parts(texts: pa.Array) -> Iterator[list[list[tuple]]]:
    """The plies of the games, by parts of few games or, where games are long, of few plies."""
    part, held = [], 0
    for text in texts:
        part.append(replay(text.as_py()))
        held += len(part[-1])
        if len(part) == _AT_ONCE or held >= _PLIES_AT_ONCE:
            yield part
            part, held = [], 0
    if part:
        yield part


@F.arrow_udf(T.ArrayType(_PLY))
def _replayed(movetexts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kinds = [pa.int32()] + [pa.string()] * (len(_PLY) - 1)
    for texts in movetexts:
        for games in _parts(texts):
            columns = list(zip(*(p for g in games for p in g))) or [[]] * len(kinds)
            moves = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_PLY.fieldNames())
            yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, games)]), pa.int32()), moves)


def plies(games: DataFrame, game_id: str = "game_id") -> DataFrame:
    """A row per move, with `clk` seconds (null if not annotated) and the game's typed headers."""
    heads = [c for c in (game_id, "white_elo", "black_elo", "result", "termination", "initial_time", "increment") if c in games.columns]
    moves = games.select(*heads, F.inline(_replayed("movetext")))
    # Step by step: an expression that names its parts several times is worked out as often.
    clock = moves.withColumn("__clock", F.regexp_extract("comment", tx.CLOCK, 1)).withColumn("__clock", tx.clock_parts(F.when(F.col("__clock") != "", F.trim("__clock"))))
    clock = clock.withColumn("__clock", tx.parts_seconds(F.col("__clock")))
    return clock.withColumn("clk", F.when(F.col("__clock") >= 0, F.col("__clock"))).drop("__clock")


def counted(df: DataFrame, name: str, **kept: Column) -> tuple[DataFrame, Observation]:
    """`df` and counters that fill while it is used for the first time: all rows, and by name those for which a condition holds."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in kept.items()]), seen


def game_endings(p: DataFrame, *, repeats: int = 5) -> DataFrame:
    """game_id, plies and ending: how the last position ends the game, or repetition if a position came `repeats` times; null if the game goes on."""
    last = p.groupBy("game_id").agg(F.max("ply").alias("plies"), F.max_by("fen_after", "ply").alias("fen"))
    seen = p.select("game_id", "fen_after").unionByName(p.filter("ply = 1").select("game_id", F.col("fen_before").alias("fen_after")))
    often = seen.groupBy("game_id", tx.strip_counters(F.col("fen_after")).alias("at")).agg(F.count(F.lit(1)).alias("n")).groupBy("game_id").agg(F.max("n").alias("n"))
    ending = F.coalesce(game_outcome("fen"), F.when(F.col("n") >= repeats, "repetition"))
    return last.join(often, "game_id").select("game_id", "plies", ending.alias("ending"))


def move_observations(p: DataFrame, *, low: int = 0, high: int = 10_000, min_ply: int = 0, min_clock: float = 0.0, recent: int = 12) -> DataFrame:
    """Histogram rows by position key: history before the move, move, clock and rating as text, count."""
    p = filters.both_in_band(p, "white_elo", "black_elo", low, high)
    p = filters.one_of(p, "termination", ["Normal", "Time forfeit"])
    p = seq.history(p, "game_id", "ply", "uci", recent, "recent_moves", with_current=False, largest=GAME_PLIES)
    p = p.withColumn("clock", F.coalesce("clk", F.lit(0.0))).filter((F.col("ply") > min_ply) & (F.col("clock") >= min_clock))
    rating = F.when(F.col("side") == "w", F.col("white_elo")).otherwise(F.col("black_elo"))
    p = p.select(tx.position_key(F.col("recent_moves"), F.col("fen_before")).alias("pos_key"), F.col("uci").alias("move"), F.format_string("%.1f", "clock").alias("clock"), rating.alias("rating"))
    return agg.count_by(p, "pos_key", "move", "clock", "rating")


def clock_records(p: DataFrame) -> DataFrame:
    """Thinking-time records; a game with an impossible clock goes as a whole."""
    p = p.filter("initial_time > 0 and white_elo is not null and black_elo is not null")
    p = seq.history(p, "game_id", "ply", "uci", 12, "recent_moves", with_current=True, largest=GAME_PLIES)
    p = joins.last_known_of_other(p.withColumn("known", F.col("clk")), "game_id", "ply", "side", "known", None, "opponent_clock", largest=GAME_PLIES)
    p = p.filter("clk is not null").withColumn("opponent_clock", F.coalesce("opponent_clock", "initial_time"))
    p = scan(p, ["game_id", "side"], ["ply"], Scan("before", "last", F.col("clk"), with_current=False), largest=GAME_PLIES)  # rows without a clock are gone
    p = seq.drop_groups_with(p, "game_id", seq.clock_jump(F.col("clk"), F.col("before"), F.col("increment")), largest=GAME_PLIES)
    own = F.coalesce("before", "initial_time")
    rating = F.when(F.col("side") == "w", F.col("white_elo")).otherwise(F.col("black_elo"))
    return p.select("game_id", "ply", F.col("fen_before").alias("fen"), "recent_moves", rating.alias("rating"), own.alias("player_clock"), "opponent_clock", "increment", F.greatest(own + F.col("increment") - F.col("clk"), F.lit(0.0)).alias("thinking_time"))


def winner_records(p: DataFrame, *, low: int = 0, high: int = 10_000, with_draws: bool = True) -> DataFrame:
    """Result records with both running clocks after the move."""
    p = p.withColumn("winner", tx.result_label(F.col("result"))).filter("initial_time > 0 and white_elo is not null and black_elo is not null and winner is not null")
    p = filters.average_in_band(p, "white_elo", "black_elo", low, high)
    p = p if with_draws else p.filter("winner <> 0")
    p = seq.history(p, "game_id", "ply", "uci", 12, "recent_moves", with_current=True, largest=GAME_PLIES)
    p = joins.clocks_upto(p, "game_id", "ply", "side", "clk", largest=GAME_PLIES).filter("clk is not null")
    p = p.withColumn("white_clock", F.coalesce("white_clock", "initial_time")).withColumn("black_clock", F.coalesce("black_clock", "initial_time"))
    return p.select("game_id", "ply", F.col("fen_after").alias("fen"), "recent_moves", "winner", "white_elo", "black_elo", "white_clock", "black_clock", "increment")


def common_positions(observations: DataFrame, threshold: int) -> DataFrame:
    """fen (without counters), moves (map) and total of positions seen more than `threshold` times, over all histories."""
    flat = observations.select(tx.strip_counters(tx.position_of_key(F.col("pos_key"))).alias("fen"), "move", "cnt")
    by_move = agg.count_by(flat, "fen", "move", count="cnt")
    often = agg.common_keys(by_move, "fen", "cnt", threshold)
    return by_move.join(often, "fen").groupBy("fen").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("move", "cnt")))).alias("moves"), F.first("total").alias("total"))
