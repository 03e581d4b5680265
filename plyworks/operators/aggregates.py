"""Aggregations: histograms, thresholds, weighted statistics, buckets, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import percentiles, running_total, tiles

def count_by(df: DataFrame, *keys: str, count: str | None = None, out: str = "cnt") -> DataFrame:
    """Observations by key; `count` holds counts that were summed before."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) if count is None else F.sum(count)).cast("long").alias(out))


def nested_histogram(flat: DataFrame, key: str, move: str, clock: str, rating: str, count: str, out: str = "moves") -> DataFrame:
    """move -> clock -> rating -> count maps from flat counts, level by level."""
    inner = flat.groupBy(key, move, clock).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(rating, count)))).alias("m"))
    middle = inner.groupBy(key, move).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(clock), F.col("m"))), lambda a, b: F.when(a[clock] < b[clock], -1).when(a[clock] > b[clock], 1).otherwise(0))).alias("m"))
    return middle.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(move, "m"))).alias(out))


def flat_histogram(nested: DataFrame, key: str, column: str = "moves") -> DataFrame:
    """The inverse: key, move, clock, rating, cnt."""
    a = nested.select(key, F.explode(column).alias("move", "m"))
    b = a.select(key, "move", F.explode("m").alias("clock", "m"))
    return b.select(key, "move", "clock", F.explode("m").alias("rating", "cnt"))


def parse_histogram(df: DataFrame, key: str, json: str) -> DataFrame:
    return flat_histogram(df.select(key, F.from_json(json, "map<string,map<string,map<string,bigint>>>").alias("moves")), key)


def within_total(flat: DataFrame, key: str, count: str, most: int) -> DataFrame:
    """Rows of keys whose counts sum to `most` at most; 0 switches the limit off."""
    if not most:
        return flat
    total = flat.groupBy(key).agg(F.sum(count).alias("__total")).filter(F.col("__total") <= most).select(key)
    return flat.join(total, key, "left_semi")


def within_total_sequential(totals: DataFrame, group: str, key: str, total: str, most: int) -> DataFrame:
    """Keys in order within a group: from the first one above `most` on, all go."""
    bad = totals.filter(F.col(total) > most).groupBy(group).agg(F.min(key).alias("__bad"))
    return totals.join(bad, group, "left").filter((F.col(total) <= most) & (F.col("__bad").isNull() | (F.col(key) < F.col("__bad")))).drop("__bad")


def common_keys(flat: DataFrame, key: str, count: str, threshold: int) -> DataFrame:
    """Keys whose counts sum to more than `threshold`, with their total."""
    return flat.groupBy(key).agg(F.sum(count).cast("long").alias("total")).filter(F.col("total") > threshold)


def route_common(df: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows of keys with at most `most` rows, counts of the other keys). Counts come first, so a hot key is never gathered."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    common = counts.filter(F.col("count") > most)
    return df.join(common, key, "left_anti"), common


def weighted_statistics(df: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """Count-weighted mean and population deviation, with the total weight."""
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    sums = df.groupBy(*keys).agg(F.sum(w).alias("n"), F.sum(v * w).alias("s"), F.sum(v * v * w).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select(*keys, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def weighted_median(df: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """Median of values that each count `weight` times, interpolated."""
    return percentiles(df, value, {"median": 0.5}, *keys, weight=weight)


def field_statistics(df: DataFrame, fields: list[str], log_fields: tuple[str, ...] = ()) -> DataFrame:
    """One row per field: count, mean and std (of log1p where asked), raw min, max, median."""
    aggs = []
    for f in fields:
        x = F.log1p(f) if f in log_fields else F.col(f).cast("double")
        aggs.append(F.struct(F.lit(f).alias("field"), F.count(f).alias("count"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(F.col(f).cast("double")).alias("min"), F.max(F.col(f).cast("double")).alias("max")))
    values = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])))
    return df.agg(F.array(*aggs).alias("s")).select(F.inline("s")).join(percentiles(values, "value", {"median": 0.5}, "field"), "field", "left")


def clock_percentiles(df: DataFrame, value: str, *keys: str, per_speed: float = 20.0) -> DataFrame:
    """p50, p95, p99 and mean of a value by keys, and the speed class of the 95th percentile over `per_speed`."""
    found = percentiles(df, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, *keys)
    return df.groupBy(*keys).agg(F.avg(value).alias("mean")).join(found, list(keys)).withColumn("speed", speed_class(F.col("p95") / per_speed))


def shares(df: DataFrame, key: str, out: str = "share") -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn(out, F.col("n") / counts.agg(F.sum("n")).scalar())


def bucket_of(value: Column, bounds: list[float]) -> Column:
    """0-based bucket of explicit bounds, clipped at both ends."""
    out = F.lit(len(bounds) - 2)
    for i in range(len(bounds) - 3, -1, -1):
        out = F.when(value < bounds[i + 1], i).otherwise(out)
    return out


def speed_class(p95: Column) -> Column:
    return F.when(p95 < 5, "bullet").when(p95 < 20, "blitz").when(p95 < 60, "rapid").otherwise("classical")


def equal_probability_bounds(df: DataFrame, value: str, start: float, n: int) -> DataFrame:
    """Rising whole-number bounds that cut the values from `start` on into n equal parts: one array `bounds`, the last infinite."""
    points = {f"p{i}": i / n for i in range(1, n)}
    cuts = percentiles(df.filter(F.col(value) >= start), value, points or {"p1": 1.0}).select(F.array(*(points or ["p1"])).alias("p"))
    rising = F.aggregate("p", F.array(F.lit(float(start))), lambda acc, x: F.concat(acc, F.array(F.greatest(F.round(x), F.element_at(acc, -1) + 1))))
    return cuts.select(F.concat(rising, F.array(F.lit(float("inf")))).alias("bounds"))


def linear_then_equal_bounds(df: DataFrame, value: str, n: int, threshold: float, width: float) -> list[float]:
    """Bounds of at most n buckets: even steps up to a threshold, then equal shares of the values above it, the last open.

    Where the first steps of the equal shares are as wide as the even ones, the even part is extended over them and the
    rest is cut anew. Each pass is one aggregate; only the bounds come to the driver.
    """

    def bounds(upto: float) -> list[float]:
        even = [k * width for k in range(round(upto / width) + 1)]
        rest = n - (len(even) - 1)
        if rest < 2:
            return even
        cuts = equal_probability_bounds(df.filter(F.col(value) > upto), value, even[-1], rest).first()
        return even + (cuts["bounds"][1:-1] if cuts else [])

    found, longest = bounds(threshold), threshold
    for a, b in zip(found, found[1:]):
        if abs(b - a - width) < 0.01:
            longest = b
        elif b - a > width:  # narrower steps are passed over
            break
    if longest > threshold:
        found = bounds(longest)
    return [*found[:n], float("inf")]


def second_shares(df: DataFrame, bucket: str, value: str) -> DataFrame:
    """Percentage of each whole second (half to even) within its bucket."""
    n = df.groupBy(bucket, F.rint(value).alias("second")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(bucket)))


def leading_values(df: DataFrame, bucket: str, value: str, most: int = 20, cover: float = 95.0) -> DataFrame:
    """A bucket's likeliest tenths, until they cover `cover` percent or there are `most`."""
    n = df.groupBy(bucket, F.bround(value, 1).alias("tenth")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(bucket).orderBy(F.desc("n"), "tenth")
    n = n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(bucket)))
    n = n.withColumn("rank", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum("percent").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return n.filter((F.col("rank") <= most) & (F.col("before") <= cover)).drop("before")


def class_weights(df: DataFrame, key: str) -> DataFrame:
    """Inverse-frequency weights with mean 1."""
    w = shares(df, key, "p").withColumn("w", 1 / (F.col("p") + 1e-6))
    return w.select(key, (F.col("w") / w.agg(F.avg("w")).scalar()).alias("weight"))


def log_loss(p: Column, y: Column, clip: float = 1e-7) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve with average ranks for ties, null if a class is missing: one row, `auc`.

    Equal scores are counted first; of the distinct ones, each range is ordered by itself.
    """
    y = F.col(label).cast("double")
    per = df.groupBy(score).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    lost = running_total(per, [score], F.col("neg"), "lost", "double")
    won = lost.select("pos", "neg", (F.col("pos") * (F.col("lost") + F.col("neg") / 2)).alias("u"))
    return won.agg(F.sum("u").alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).alias("auc"))


def calibration(df: DataFrame, score: str, target: str, order: list[str], n: int = 10) -> DataFrame:
    """Mean prediction and outcome of n bins of equal size."""
    bins = tiles(df, [score, *order], n, "bin")
    return bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("predicted"), F.avg(F.col(target).cast("double")).alias("observed"))


def confusion(df: DataFrame, target: str, predicted: str) -> DataFrame:
    return df.groupBy(target, predicted).agg(F.count(F.lit(1)).alias("n"))


def last_write(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def tops_at(df: DataFrame, rank: str, *ks: int) -> DataFrame:
    """Share of rows whose rank is at most k."""
    return df.agg(*[F.avg((F.col(rank) <= k).cast("double")).alias(f"top{k}") for k in ks])


def phase(position: Column, length: Column) -> Column:
    """early (first fifth), late (last fifth) or middle, of a 0-based position."""
    return F.when(position < 0.2 * length, "early").when(position >= 0.8 * length, "late").otherwise("middle")


def key_repeats(df: DataFrame, *key: str) -> DataFrame:
    """One row: distinct keys, and how many of them come more than once."""
    return count_by(df, *key).agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("cnt") > 1).alias("repeated"))


def result_totals(df: DataFrame, key: str, won: Column, lost: Column) -> DataFrame:
    """Games, wins, losses and the percentage of wins by key."""
    wins = F.count_if(won)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("games"), wins.alias("wins"), F.count_if(lost).alias("losses"), (100.0 * wins / F.count(F.lit(1))).alias("win_percent"))


def json_total(df: DataFrame, key: str, json: str, field: str) -> DataFrame:
    """Sum of a number that JSON objects hold under `field`, by key."""
    return df.select(key, F.from_json(json, f"{field} bigint")[field].alias(field)).groupBy(key).agg(F.sum(field).alias(field))
