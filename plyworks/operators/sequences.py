"""Windows over ordered rows, top-k, sampling and seeded order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import seeded_unit
from .ordered import MAX_GROUP, Scan, row_numbers, scan


def history(df: DataFrame, group: str, order: str, value: str, n: int, out: str, *, with_current: bool, **options) -> DataFrame:
    """The last n values before the row, or up to it, oldest first."""
    return scan(df, [group], [order], Scan(out, "rows", F.col(value), n, with_current), **options)


def thinking_time(df: DataFrame, group: list[str], order: str, clock: str, increment: Column, initial: Column, out: str, **options) -> DataFrame:
    """Own clock before, plus increment, minus own clock now; 0 at least."""
    rows = scan(df, group, [order], Scan("__before", "rows", F.col(clock), 1, with_current=False), **options)
    before = F.coalesce(F.get("__before", 0), initial)
    return rows.withColumn(out, F.greatest(before + increment - F.col(clock), F.lit(0.0))).drop("__before")


def drop_groups_with(df: DataFrame, group: str, bad: Column, *, largest: int | None = None) -> DataFrame:
    """Groups in which `bad` holds for no row; a null group is one, too.

    Bad groups are found by an aggregate and a join, so no group meets in one task; where `largest` says that groups are small by their
    nature, by a window, which reads `df` once."""
    if largest is not None and largest <= MAX_GROUP:
        return df.withColumn("__bad", F.max(F.coalesce(bad, F.lit(False))).over(Window.partitionBy(group))).filter(~F.col("__bad")).drop("__bad")
    gone = df.filter(F.coalesce(bad, F.lit(False))).select(F.col(group).alias("__gone")).distinct()
    return df.join(gone, F.col(group).eqNullSafe(F.col("__gone")), "left_anti")


def clock_jump(clock: Column, before: Column, increment: Column) -> Column:
    """A clock that rose: at all without increment, by twice the increment or more with one. The first clock (no `before`) is exempt."""
    rise = clock - before
    return F.coalesce(((increment == 0) & (rise > 0)) | ((increment > 0) & (rise >= 2 * increment)), F.lit(False))


def first_of_each(df: DataFrame, stratum: str, order: list, n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def running(df: DataFrame, group: str, order: list, value: str, total: str, maximum: str, **options) -> DataFrame:
    return scan(df, [group], order, Scan(total, "sum", F.col(value)), Scan(maximum, "max", F.col(value)), **options)


def new_maxima(df: DataFrame, group: str, order: list, value: str, **options) -> DataFrame:
    """Rows above all before them."""
    rows = scan(df, [group], order, Scan("__m", "max", F.col(value), with_current=False), **options)
    return rows.filter(F.col("__m").isNull() | (F.col(value) > F.col("__m"))).drop("__m")


def rolling_mean(df: DataFrame, group: str, order: list, value: str, n: int, out: str, **options) -> DataFrame:
    """Mean of the last n values, this row's included; nulls don't count."""
    rows = scan(df, [group], order, Scan("__last", "rows", F.col(value).cast("double"), n), **options)
    added = F.aggregate("__last", F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn(out, F.when(F.size("__last") > 0, added / F.size("__last"))).drop("__last")


def ends_mean(df: DataFrame, group: str, order: list[str], value: str, n: int) -> DataFrame:
    """Mean of the first n and of the last n rows of each group. Tasks keep n rows a group at either end before rows are shuffled."""
    def mean(order: list, out: str) -> DataFrame:
        kept = df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__n") <= n)
        return kept.groupBy(F.col(group).alias("__g")).agg(F.avg(value).alias(out))

    first, last = mean(list(order), "first_mean").alias("f"), mean([F.desc(c) for c in order], "last_mean").alias("l")
    return first.join(last, F.col("f.__g").eqNullSafe(F.col("l.__g"))).select(F.col("f.__g").alias(group), "first_mean", "last_mean")


def top_k(df: DataFrame, k: int, score: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(score), *ties).limit(k)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of at least 1 and at most 100 rows."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 1), 100))


def seeded_place(seed: int, *keys: str) -> Column:
    """A place in an order that depends on the seed and the keys alone, the same in any engine: hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def seeded_order(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """All rows in an order that depends on the seed alone; equal keys fall anywhere."""
    return df.orderBy(seeded_place(seed, *keys), *keys)


def seeded_rank(df: DataFrame, seed: int, *keys: str, out: str = "place") -> DataFrame:
    """Adds the place of each row in the seeded order, from 1."""
    return row_numbers(df.withColumn("__h", seeded_place(seed, *keys)), ["__h", *keys], out).drop("__h")


def seeded_buckets(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """The seeded order without a global sort: n partitions by hash, each in order."""
    h = seeded_place(seed, *keys)
    return df.repartition(n, h).sortWithinPartitions(h)


def seeded_sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows without replacement."""
    return seeded_order(df, seed, *keys).limit(n)


def weighted_choice(df: DataFrame, group: str, item: str, weight: str, seed: int, **options) -> DataFrame:
    """One item per group, with probability in proportion to its weight, by a hash of group and seed: the item on which a mark falls."""
    run = scan(df, [group], [item], Scan("__upto", "sum", F.col(weight)), **options)
    total = df.groupBy(F.col(group).alias("__g")).agg((seeded_unit(seed, F.col(group)) * F.sum(weight)).alias("__mark"))
    rows = run.join(total, F.col(group).eqNullSafe(F.col("__g"))).filter(F.col("__upto") > F.col("__mark"))
    return rows.groupBy(group).agg(F.min(item).alias(item))


def race_key(seed: int, weight: Column, *keys: Column) -> Column:
    """When an item comes in, in a race of exponential clocks of rate `weight`: the first of a group is a draw in proportion to the
    weights, the first k are k draws without replacement. From a hash of seed and keys, the same in any engine; null if the weight is not positive."""
    return F.when(weight > 0, -F.log(1 - seeded_unit(seed, *keys)) / weight)


def weighted_draw(df: DataFrame, group: str, item: str, weight: str, seed: int) -> DataFrame:
    """One item per group, drawn in proportion to its weight. A minimum by group, which tasks combine before rows are shuffled; items are distinct inside a group."""
    keyed = df.withColumn("__key", race_key(seed, F.col(weight), F.col(group), F.col(item))).filter("__key is not null")
    return keyed.groupBy(group).agg(F.min(F.struct("__key", item)).alias("__drawn")).select(group, F.col("__drawn")[item].alias(item))


def weighted_draws(df: DataFrame, group: str, item: str, weight: str, k: int, seed: int, out: str = "place") -> DataFrame:
    """k items per group (all, if fewer have a weight) without replacement, and the place of each. Tasks keep k items a group before rows are shuffled."""
    keyed = df.select(group, item, race_key(seed, F.col(weight), F.col(group), F.col(item)).alias("__key")).filter("__key is not null")
    return keyed.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy("__key", item))).filter(F.col(out) <= k).drop("__key")


def round_robin(df: DataFrame, order: list, n: int, out: str = "shard") -> DataFrame:
    return row_numbers(df, order, out).withColumn(out, ((F.col(out) - 1) % n).cast("int"))


def tumbling(df: DataFrame, ts: str, width: str, *keys: str, out: str = "start") -> DataFrame:
    """Rows by keys and window of time, the window's start in seconds."""
    return df.groupBy(*keys, F.unix_timestamp(F.window(ts, width)["start"]).alias(out)).agg(F.count(F.lit(1)).alias("n"))
