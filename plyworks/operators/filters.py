"""Predicates and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def both_in_band(df: DataFrame, a: str, b: str, low: float, high: float) -> DataFrame:
    """Rows whose two values both lie in [low, high]; unreadable values drop the row."""
    return df.filter(F.col(a).try_cast("double").between(low, high) & F.col(b).try_cast("double").between(low, high))


def average_in_band(df: DataFrame, a: str, b: str, low: int, high: int) -> DataFrame:
    """Rows whose integer average lies in [low, high]."""
    return df.filter(F.expr(f"(cast({a} as long) + cast({b} as long)) div 2").between(low, high))


def one_of(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(F.col(column).isin(values))


def range_reason(limits: dict[str, tuple[float, float]]) -> Column:
    """The first column that is missing, not finite or out of its limits, as `column: reason`; null if none is."""
    out = F.lit(None).cast("string")
    for name, (low, high) in reversed(limits.items()):
        x = F.col(name).try_cast("double")
        out = F.when(x.isNull(), f"{name}: missing").when(F.isnan(x) | (F.abs(x) == float("inf")), f"{name}: not finite").when(~x.between(low, high), f"{name}: out of range").otherwise(out)
    return out


#: Limits of clock and winner records.
CLOCK_LIMITS = {"rating": (0, 10000), "player_clock": (0, 3600), "opponent_clock": (0, 3600), "increment": (0, 60), "thinking_time": (0, 600)}
WINNER_LIMITS = {"winner": (-1, 1), "white_rating": (100, 4000), "black_rating": (100, 4000), "white_clock": (0, 7200), "black_clock": (0, 7200), "increment": (0, 120)}


#: What a request may name.
RATING_LIMITS, COLOURS, RESULTS = (100, 3500), ("white", "black"), ("win", "loss", "draw")


def request_reason(rating: str, colour: str | None = None, result: str | None = None) -> Column:
    """The first field of a request that breaks its rule, as `field: reason`; null if the request may pass."""
    out = F.lit(None).cast("string")
    for name, allowed in ((result, RESULTS), (colour, COLOURS)):
        if name:
            out = F.when(F.col(name).isNull(), f"{name}: missing").when(~F.col(name).isin(*allowed), f"{name}: not allowed").otherwise(out)
    return F.coalesce(range_reason({rating: RATING_LIMITS}), out)


def likely_or_all(df: DataFrame, group: str, value: str, least: float) -> DataFrame:
    """Rows of at least `least`; a group in which none has it keeps all."""
    top = df.withColumn("__top", F.max(value).over(Window.partitionBy(group)))
    return top.filter((F.col(value) >= least) | (F.col("__top") < least)).drop("__top")


def late_positions(df: DataFrame, fen: str, least: int) -> DataFrame:
    """Rows whose full-move number is at least `least`; malformed positions go."""
    return df.filter(F.get(F.split(F.col(fen), " "), 5).try_cast("int") >= least)


def first_rows(df: DataFrame, index: str, n: int) -> DataFrame:
    return df.filter(F.col(index) < n)
