"""Rows of model inputs from training records: tokens, masks, scaled numbers and targets, all as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import text as tx
from ..functions.registry import legal_move_ids
from .serving import draw_pair

Scales = dict[str, tuple[float, float]]


def input_ids(history: Column, fen: Column) -> Column:
    """Tokens of the last moves, then of the position."""
    vocabulary = tx.move_vocabulary()
    return F.concat(tx.history_tokens(history, vocabulary, len(vocabulary)), tx.fen_tokens(fen))


def _inputs(records: DataFrame) -> DataFrame:
    df = records.withColumn("input_ids", input_ids(F.col("recent_moves"), F.col("fen")))
    return df.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1))).withColumn("legal_ids", legal_move_ids("fen"))


def _scaled(scales: Scales, field: str, column: str | None = None) -> Column:
    x = F.col(column or field)
    return num.log_z_score(x, *scales[field]) if field.endswith("clock") or field in ("increment", "time") else num.z_score(x, *scales[field])


def clock_samples(records: DataFrame, scales: Scales, bounds: list[float]) -> DataFrame:
    """Inputs and the thinking time's bucket. scales: (mean, deviation) of rating, player_clock, opponent_clock and increment, the last three of log1p."""
    edges = F.array(*map(F.lit, bounds))
    reachable = num.bucket_index(F.col("player_clock") + F.col("increment"), edges)
    return _inputs(records).select(
        "input_ids", "attention_mask", "legal_ids", _scaled(scales, "rating").alias("rating"),
        F.array(*[_scaled(scales, f) for f in ("player_clock", "opponent_clock", "increment")]).alias("clock_features"),
        num.bucket_mask(reachable, len(bounds) - 1).alias("bucket_mask"), num.bucket_index(F.col("thinking_time"), edges).alias("target_bucket"), "thinking_time",
    )


def winner_samples(records: DataFrame, scales: Scales) -> DataFrame:
    """Inputs and the result's class. scales as for clocks, of white_elo, black_elo, white_clock, black_clock and increment."""
    fields = ("white_elo", "black_elo", "white_clock", "black_clock", "increment")
    return _inputs(records).select(
        "input_ids", "attention_mask", "legal_ids", F.array(*[_scaled(scales, f) for f in fields]).alias("features"), tx.result_class(F.col("winner")).alias("winner"),
        F.col("winner").alias("winner_raw"), *fields,
    )


def move_samples(records: DataFrame, record_id: str, scales: Scales, seed: int) -> DataFrame:
    """Inputs and a move, drawn with its rating and clock in proportion to the record's counts.

    records: recent_moves, fen and moves (move -> clock -> rating -> count). scales: of rating and time, the latter of log1p.
    """
    drawn = draw_pair(records, record_id, seed)
    return _inputs(drawn).select(
        record_id, "input_ids", "attention_mask", "legal_ids", F.col("move"), tx.move_id(F.col("move"), tx.move_vocabulary()).alias("move_id"),
        _scaled(scales, "rating").alias("rating"), _scaled(scales, "time", "clock").alias("log_time"),
    )
