"""Join-shaped operators. Sides are broadcast by Spark where their size allows; nothing is hinted unless it is a fixed list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Scan, by_ranges, scan

#: Rows of a range of values and intervals, which a task sorts.
RANGE_ROWS = 200_000


def without_common(df: DataFrame, common: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in `common`."""
    return df.join(common.select(key), key, "left_anti")


def flag_common(df: DataFrame, common: DataFrame, key: str, flag: str) -> DataFrame:
    known = common.select(key, F.lit(True).alias(flag)).distinct()
    return df.join(known, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def cascade(df: DataFrame, steps: list[tuple[str, DataFrame, str, str]], out: str, strategy: str) -> DataFrame:
    """The first table that knows a row's key gives `out`, and its name `strategy`.

    steps: (name, table, key column in df, value column); each table has the key under the name `key`, once; values are of one type.
    Each table is a left join of its own, which Spark broadcasts or splits where keys are frequent, so rows stream by, none is
    multiplied and none waits for the others of its key. Null values and null keys are not known.
    """
    hit = []
    for n, (name, table, key, value) in enumerate(steps):
        kind = table.schema["key"].dataType
        known = table.filter(F.col("key").isNotNull() & F.col(value).isNotNull()).select(F.col("key").cast("string").alias(f"__key{n}"), F.col(value).alias(f"__value{n}"), F.lit(name).alias(f"__name{n}"))
        df = df.join(known, F.col(key).cast(kind).cast("string") == F.col(f"__key{n}"), "left").drop(f"__key{n}")
        hit += [f"__value{n}", f"__name{n}"]
    found = df.withColumn(out, F.coalesce(*hit[::2])).withColumn(strategy, F.coalesce(*hit[1::2], F.lit("not found")))
    return found.drop(*hit)


def in_band(df: DataFrame, value: str, bands: list[tuple[float, float, str]], out: str) -> DataFrame:
    """Name of the band [low, high) that holds the value; null outside all. The list of bands is part of the plan."""
    c = F.lit(None).cast("string")
    for low, high, name in reversed(bands):
        c = F.when((F.col(value) >= low) & (F.col(value) < high), name).otherwise(c)
    return df.withColumn(out, c)


def nearest_band(df: DataFrame, value: str, bands: list[tuple[int, int, str]], out: str, distance: str) -> DataFrame:
    """Name of the nearest band: 0 inside [low, high), low - v below, v - high + 1 above; ties go to the lower band."""
    v = F.col(value)
    options = [F.struct(F.when(v < low, low - v).when(v >= high, v - high + 1).otherwise(F.lit(0)).cast("double").alias("d"), F.lit(low).alias("low"), F.lit(name).alias("name")) for low, high, name in bands]
    best = F.array_min(F.array(*options))
    return df.withColumn(out, best["name"]).withColumn(distance, best["d"])


def _beside(df: DataFrame, value: str, bands: DataFrame, low: str, high: str, *, after: bool) -> DataFrame:
    """`df` with __low, the band that begins last at or before the value, and with `after` __high, the one that begins first behind it.

    Values and the beginnings of bands are put in one order, dealt by its ranges, and each value takes over the band that came last;
    a range takes over the last band of earlier ranges, one row each. So neither a value that many rows have nor the bands meet in one task."""
    row = F.struct(*[F.col(c) for c in df.columns])
    band = F.struct(F.col(low).alias("low"), F.col(high).alias("high"), *[F.col(c) for c in bands.columns if c not in (low, high)])
    row_type, band_type = df.select(row.alias("x")).schema["x"].dataType, bands.select(band.alias("x")).schema["x"].dataType
    points = df.select(F.col(value).alias("__at"), F.lit(1).alias("__kind"), F.monotonically_increasing_id().alias("__salt"), row.alias("__row"), F.lit(None).cast(band_type).alias("__band"))
    begins = bands.filter(F.col(low) < F.col(high)).select(F.col(low).alias("__at"), F.lit(0).alias("__kind"), F.lit(0).cast("long").alias("__salt"), F.lit(None).cast(row_type).alias("__row"), band.alias("__band"))
    order = ["__at", "__kind", "__salt"]  # the salt lets rows of one value fall in several ranges
    # As many ranges as the rows need, whatever the session's number of partitions, and as many tasks for them.
    ranges = -(-(df.count() + bands.count()) // RANGE_ROWS)
    spread = ranges > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = by_ranges(points.unionByName(begins), order, ranges if spread else None)
    edges = both.filter("__kind = 0").groupBy("__range").agg(F.min_by("__band", "__at").alias("__first"), F.max_by("__band", "__at").alias("__last"))
    edges = both.select("__range").distinct().join(edges, "__range", "left")  # a row a range
    # Both ways a row looks back, in rising or falling order: a frame that grows as rows come, which is one pass.
    back, part = (Window.unboundedPreceding, -1), Window.partitionBy("__range")
    last = lambda c, window: F.last(c, ignorenulls=True).over(window.rowsBetween(*back))
    carried = edges.select("__range", last("__last", Window.orderBy("__range")).alias("__before"), last("__first", Window.orderBy(F.desc("__range"))).alias("__after"))
    dealt = both.repartition(ranges, "__range") if spread else both
    known = dealt.withColumn("__low", last("__band", part.orderBy(*order)))
    known = known.withColumn("__high", last("__band", part.orderBy(*[F.desc(c) for c in order]))) if after else known
    known = known.filter("__kind = 1").join(F.broadcast(carried), "__range")
    beside = [F.coalesce("__low", "__before").alias("__low"), *[F.coalesce("__high", "__after").alias("__high")] * after]
    return known.select("__row.*", *beside)


def in_intervals(df: DataFrame, value: str, bands: DataFrame, low: str, high: str) -> DataFrame:
    """`df` with the columns of the band [low, high) that holds the value; nulls outside all, and for a null value.

    bands: any number of rows, which don't overlap (of those that do, the one that begins last before the value is asked)."""
    known = _beside(df.filter(F.col(value).isNotNull()), value, bands, low, high, after=False)
    held = F.col(value) < F.col("__low.high")
    names = [c for c in bands.columns if c not in df.columns]
    inside = known.select(*df.columns, *[F.when(held, F.col("__low")["low" if c == low else "high" if c == high else c]).alias(c) for c in names])
    kinds = {f.name: f.dataType for f in bands.schema}
    return inside.unionByName(df.filter(F.col(value).isNull()).select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in names]))


def nearest_interval(df: DataFrame, value: str, bands: DataFrame, low: str, high: str, name: str, out: str, distance: str) -> DataFrame:
    """Adds `out`, the name of the nearest band, and its distance: 0 inside [low, high), low - v below, v - high + 1 above; ties go to the lower band.

    Of bands that don't overlap only the two that begin last before and first behind a value can be nearest. Rows with a null value stay, with nulls."""
    v, below, above = F.col(value).cast("double"), F.col("__low"), F.col("__high")
    known = _beside(df.filter(F.col(value).isNotNull()), value, bands.select(low, high, name), low, high, after=True)
    d_low = F.when(v < below["high"], F.lit(0.0)).otherwise(v - below["high"] + 1)
    d_high = above["low"] - v
    lower = below.isNotNull() & (above.isNull() | (d_low <= d_high))
    found = known.withColumn(out, F.when(lower, below[name]).otherwise(above[name])).withColumn(distance, F.when(lower, d_low).otherwise(d_high).cast("double"))
    kind = bands.schema[name].dataType
    return found.drop("__low", "__high").unionByName(df.filter(F.col(value).isNull()).withColumn(out, F.lit(None).cast(kind)).withColumn(distance, F.lit(None).cast("double")))


def key_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that are missing on a side or differ: key, left, right and `state`."""
    left, right = a.select(F.col(key).alias("key"), F.col(value).alias("left")), b.select(F.col(key).alias("key"), F.col(value).alias("right"))
    state = F.when(F.col("in_left").isNull(), "only right").when(F.col("in_right").isNull(), "only left").when(~F.col("left").eqNullSafe(F.col("right")), "differs")
    both = left.withColumn("in_left", F.lit(1)).join(right.withColumn("in_right", F.lit(1)), "key", "full")
    return both.withColumn("state", state).filter("state is not null").select("key", "left", "right", "state")


def last_known_of_other(df: DataFrame, group: str, order: str, side: str, value: str, initial, out: str, **options) -> DataFrame:
    """The other side's last value before this row, or `initial`. side holds 'w' or 'b'."""
    last = lambda name, s: Scan(name, "last", F.when(F.col(side) == s, F.col(value)), with_current=False)
    found = scan(df, [group], [order], last("__white", "w"), last("__black", "b"), **options)
    return found.withColumn(out, F.coalesce(F.when(F.col(side) == "w", F.col("__black")).otherwise(F.col("__white")), F.lit(initial))).drop("__white", "__black")


def clocks_upto(df: DataFrame, group: str, order: str, side: str, clock: str, **options) -> DataFrame:
    """Adds white_clock and black_clock, the last known clock of either side up to this row."""
    last = lambda out, s: Scan(out, "last", F.when(F.col(side) == s, F.col(clock)))
    return scan(df, [group], [order], last("white_clock", "w"), last("black_clock", "b"), **options)


def set_sizes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of keys in `a` only, in `b` only and in both, and of both sets together; the sets hold each key once."""
    marked = a.select(key, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select(key, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    per = marked.groupBy(key).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    in_a, in_b = F.col("__a") > 0, F.col("__b") > 0
    counts = per.agg(F.count_if(in_a & ~in_b).alias("only a"), F.count_if(in_b & ~in_a).alias("only b"), F.count_if(in_a & in_b).alias("both"), F.coalesce(F.sum(F.col("__a") + F.col("__b")), F.lit(0)).alias("all"))
    return counts.unpivot([], ["only a", "only b", "both", "all"], "part", "n")
