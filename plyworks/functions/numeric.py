"""Expressions over numbers, vectors and ratings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_score(x: Column, mean, std) -> Column:
    return (x - mean) / std


def log_z_score(x: Column, mean, std) -> Column:
    return (F.log1p(x) - mean) / std


def bucket_index(x: Column, bounds: Column) -> Column:
    """Index of the bucket [bounds[i], bounds[i+1]) that holds x, clipped to the first and last one."""
    below = F.size(F.filter(F.slice(bounds, 1, F.size(bounds) - 1), lambda b: b <= x)) - 1
    return F.greatest(below, F.lit(0)).cast("int")


def bucket_center(i: Column, bounds: Column, tail_mean: float) -> Column:
    """Middle of bucket i; the open last one stands for `tail_mean`."""
    low, high = F.get(bounds, i), F.get(bounds, i + 1)
    return F.when(high == float("inf"), F.lit(tail_mean)).otherwise((low + high) / 2)


def bucket_width(i: Column, bounds: Column) -> Column:
    high = F.get(bounds, i + 1)
    return F.when(high != float("inf"), high - F.get(bounds, i))


def bucket_mask(max_bucket: Column, n: int) -> Column:
    """1 for the buckets that can be reached; the first always can."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: ((i <= max_bucket) | (i == 0)).cast("int"))


def l1_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def total_variation(a: Column, b: Column) -> Column:
    return l1_distance(a, b) / 2


def softmax(z: Column) -> Column:
    e = F.transform(z, lambda x: F.exp(x.cast("double") - F.array_max(z).cast("double")))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def masked_softmax(z: Column, mask: Column) -> Column:
    """Softmax over the entries whose mask is set; 0 elsewhere."""
    top = F.array_max(F.zip_with(z, mask, lambda x, m: F.when(m > 0, x.cast("double"))))
    e = F.zip_with(z, mask, lambda x, m: F.when(m > 0, F.exp(x.cast("double") - top)).otherwise(0.0))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def brier(probabilities: Column, target: Column) -> Column:
    """Sum of squared differences from the one-hot target (0-based)."""
    return F.aggregate(F.transform(probabilities, lambda p, i: F.pow(p - (i == target).cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def scalar_evaluation(white: Column, draw: Column, black: Column) -> Column:
    """white - black + draw / 2, as published."""
    return white - black + draw * 0.5


def balanced_evaluation(white: Column, black: Column) -> Column:
    """white - black: a sure draw is 0."""
    return white - black


def expected_for_side(white: Column, draw: Column, black: Column, side: Column) -> Column:
    return F.when(side == "w", white).otherwise(black) + draw * 0.5


def assessment(value: Column) -> Column:
    return F.when(value > 0.1, "White is better").when(value < -0.1, "Black is better").otherwise("Position is equal")


def keep_likely(moves: Column, least: float) -> Column:
    """The entries (struct with field p) of at least `least`; all of them if none has it."""
    likely = F.filter(moves, lambda m: m["p"] >= least)
    return F.when(F.size(likely) == 0, moves).otherwise(likely)


def top_entries(probabilities: Column, k: int) -> Column:
    """The k likeliest entries of a map, ties by key: array<struct<move, p>>."""
    items = F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("move")))
    return F.transform(F.slice(F.array_sort(items), 1, k), lambda e: F.struct(e["move"].alias("move"), (-e["n"]).alias("p")))


def elo_expected(difference: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -difference / 400.0))


#: Fixed values of the single-game rating update.
START_RD, LEAST_RD, MOST_RD, LEAST_RATING, MOST_RATING, GROWTH_PER_DAY = 350.0, 30.0, 350.0, 100.0, 3500.0, 34.64
_Q = math.log(10) / 400


def spread_factor(rd: Column) -> Column:
    return 1 / F.sqrt(1 + 3 * _Q * _Q * rd * rd / (math.pi * math.pi))


def inflated_rd(rd: Column, days: Column) -> Column:
    """Deviation after so many inactive days."""
    return F.least(F.lit(MOST_RD), F.sqrt(rd * rd + GROWTH_PER_DAY * F.greatest(days, F.lit(0))))


def idle_days(last: Column, now: Column) -> Column:
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(last)) / 86400)


def game_step(rating, rd, opponent, opponent_rd, score, sqrt, power):
    """(change, deviation) of one game, of columns or of numbers, with the functions for them."""
    g = 1 / sqrt(1 + 3 * _Q * _Q * opponent_rd * opponent_rd / (math.pi * math.pi))
    e = 1 / (1 + power(10.0, -g * (rating - opponent) / 400.0))
    precision = 1 / (rd * rd) + _Q * _Q * g * g * e * (1 - e)
    return _Q / precision * g * (score - e), sqrt(1 / precision)


def single_game_update(rating: Column, rd: Column, opponent: Column, opponent_rd: Column, score: Column) -> tuple[Column, Column]:
    """(rating, rd) after one game, clamped, to one decimal."""
    change, new_rd = game_step(rating, rd, opponent, opponent_rd, score, F.sqrt, lambda a, b: F.pow(F.lit(a), b))
    return (
        F.round(F.least(F.greatest(rating + change, F.lit(LEAST_RATING)), F.lit(MOST_RATING)), 1),
        F.round(F.least(F.greatest(new_rd, F.lit(LEAST_RD)), F.lit(MOST_RD)), 1),
    )


#: The tiers, and the rating below which each holds (the last has no limit).
TIERS = (
    (800, "Beginner"), (1000, "Novice"), (1200, "Intermediate"), (1400, "Club Player"), (1600, "Tournament Player"), (1800, "Expert"),
    (2000, "Candidate Master"), (2200, "Master"), (2400, "International Master"), (None, "Grandmaster"),
)


def rating_tier(rating: Column) -> Column:
    out = F.lit(TIERS[-1][1])
    for below, name in reversed(TIERS[:-1]):
        out = F.when(rating < below, name).otherwise(out)
    return out


def edited_rd(rd: Column) -> Column:
    return F.least(F.lit(MOST_RD), rd + 50)


def is_provisional(rd: Column) -> Column:
    return rd > 110


def confidence_95(rating: Column, rd: Column) -> tuple[Column, Column]:
    return rating - 1.96 * rd, rating + 1.96 * rd


def would_forfeit(think: Column, clock: Column, increment: Column) -> Column:
    return think > clock + increment


def seeded_unit(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a hash of the keys: the same on every run and in any engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def uniform_between(u: Column, low: Column, high: Column) -> Column:
    return low + u * (high - low)


def exponential_tail(u: Column, low: Column, mean) -> Column:
    return low - mean * F.log(1 - u)
