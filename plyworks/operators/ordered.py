"""Row numbers, running totals and exact percentiles over whole tables, where no task sees more than a range of the rows."""

from __future__ import annotations

import atexit
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Only a local session without one (a test) gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="plyworks-"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there, so that it is the same for all that use it, and a lost executor costs one stage."""
    shared_folder(df.sparkSession)
    kept = df.checkpoint()
    file = kept._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        remember(file.get())
    return kept


#: Paths of tables that are not the result of anything, by scope; the first scope ends with the process.
_SCOPES: list[list[str]] = [[]]


def remember(path: str) -> None:
    """Has a table removed when the scope ends in which it was written."""
    _SCOPES[-1].append(path)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go when it is left; write what you need of them before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        _remove(spark, _SCOPES.pop())


@atexit.register
def _last_scope() -> None:
    spark = SparkSession.getActiveSession() if SparkContext._active_spark_context is not None else None
    if spark is not None:
        _remove(spark, _SCOPES[0])


def by_ranges(df: DataFrame, order: list, ranges: int | None = None) -> DataFrame:
    """Rows dealt by ranges of `order` (so many, or as the session has it); __range rises with it. Ranges are drawn by sampling, so they are kept in a written table."""
    return written(df.repartitionByRange(*[ranges] * (ranges is not None), *order).withColumn("__range", F.spark_partition_id()))


def _running(ranged: DataFrame, order: list, value: Column, out: str, kind: str) -> DataFrame:
    totals = ranged.groupBy("__range").agg(F.sum(value).cast(kind).alias("part"))  # a row a partition
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__range", F.coalesce(F.sum("part").over(before), F.lit(0)).cast(kind).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = F.coalesce(F.sum(value).over(inside), F.lit(0)).cast(kind)
    return ranged.join(F.broadcast(starts), "__range").withColumn(out, F.col("__before") + summed).drop("__range", "__before")


def running_total(df: DataFrame, order: list, value: Column, out: str, kind: str = "long") -> DataFrame:
    """Adds `out`, the sum of `value` over all rows before this one in `order`, which should be a total order."""
    return _running(by_ranges(df, order), order, value, out, kind)


def row_numbers(df: DataFrame, order: list, out: str = "row") -> DataFrame:
    """Adds `out`, the place of each row in `order`, from 1."""
    return running_total(df, order, F.lit(1), out).withColumn(out, F.col(out) + 1)


def tiles(df: DataFrame, order: list, n: int, out: str) -> DataFrame:
    """Adds `out`, from 1 to n: n runs of rows in `order`, as equal as can be, the longer ones first."""
    ranged = by_ranges(df, order)
    size, longer = divmod(ranged.count(), n)
    row = F.col(out)
    upto = longer * (size + 1)
    tile = F.when(row < upto, F.floor(row / (size + 1)) + 1)
    tile = tile.otherwise(longer + F.floor((row - upto) / size) + 1) if size else tile
    return _running(ranged, order, F.lit(1), out, "long").withColumn(out, tile.cast("int"))


def percentiles(df: DataFrame, value: str, points: dict[str, float], *keys: str, weight: str | None = None) -> DataFrame:
    """Exact percentiles of `value` by keys, interpolated between neighbours: a row per key, a column per point.

    `weight` tells how often a value counts. Nulls don't count. Distinct values are counted first, and their running
    counts tell which of them a percentile falls on, so neither a key's values nor the table's meet in one task.
    """
    by = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("__k0")]
    names = [f"__k{i}" for i in range(len(by))]
    n = F.count(F.lit(1)) if weight is None else F.sum(F.col(weight).cast("long"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(n.alias("__n")).filter("__n > 0")
    run = running_total(counts, [*names, "__v"], F.col("__n"), "__at")
    per = run.groupBy(*names).agg(F.sum("__n").alias("__all"), F.min("__at").alias("__start"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in names]
    both = run.alias("r").join(per.alias("p"), same).select(*[F.col(f"r.{k}") for k in names], "__v", "__n", "__all", (F.col("__at") - F.col("__start")).alias("__at"))
    out, aggs = [], [F.first("__all").alias("__all")]
    for name, q in points.items():
        place = F.lit(q) * (F.col("__all") - 1)
        holds = lambda i: F.max(F.when((F.col("__at") <= i) & (i < F.col("__at") + F.col("__n")), F.col("__v")))
        aggs += [holds(F.floor(place)).alias(f"__low_{name}"), holds(F.ceil(place)).alias(f"__high_{name}")]
        low, high = F.col(f"__low_{name}"), F.col(f"__high_{name}")
        out.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(name))
    found = both.groupBy(*names).agg(*aggs)
    return found.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], *out)


#: Rows of a group that one task may order; larger groups are scanned by ranges.
MAX_GROUP = 1_000_000


@dataclass
class Scan:
    """A value over the rows of a group up to a row: `sum`, `max`, `last` (that is not null) or `rows` (of the last n rows, those not null, oldest first)."""

    out: str
    kind: str
    value: Column
    n: int = 0
    with_current: bool = True

    def over(self, window: Window, with_current: bool) -> Column:
        end = 0 if with_current else -1
        upto = window.rowsBetween(Window.unboundedPreceding, end)
        if self.kind == "sum":
            return F.sum(self.value).over(upto)
        if self.kind == "max":
            return F.max(self.value).over(upto)
        if self.kind == "last":
            return F.last(self.value, ignorenulls=True).over(upto)
        return F.collect_list(F.struct(self.value.alias("v"))).over(window.rowsBetween(end - self.n + 1, end))

    def whole(self, window: Window) -> Column:
        """Over a window that sees the whole group."""
        if self.kind == "rows":
            end = 0 if self.with_current else -1
            return F.collect_list(self.value).over(window.rowsBetween(end - self.n + 1, end))
        return self.over(window, self.with_current)

    def over_ranges(self, part: Column, window: Window) -> Column:
        """What ranges up to one make together."""
        if self.kind == "rows":
            return self.clipped(F.flatten(F.collect_list(part).over(window)))
        return {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[self.kind](part).over(window)

    def clipped(self, rows: Column) -> Column:
        return F.when(F.size(rows) > self.n, F.slice(rows, -self.n, self.n)).otherwise(rows)

    def joined(self, before: Column, own: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(before + own, before, own)
        if self.kind == "max":
            return F.greatest(before, own)
        if self.kind == "last":
            return F.coalesce(own, before)
        return F.when(before.isNull(), own).otherwise(self.clipped(F.concat(before, own)))

    def shown(self, found: Column) -> Column:
        return F.transform(F.filter(found, lambda r: r["v"].isNotNull()), lambda r: r["v"]) if self.kind == "rows" else found


def scan(df: DataFrame, group: list[str], order: list, *scans: Scan, max_group: int = MAX_GROUP, largest: int | None = None) -> DataFrame:
    """Adds what `scans` ask for, over the rows of each group in `order`, which should be a total order inside it.

    Groups are counted first, unless `largest` says how many rows one has at most by its nature. If none has over `max_group` rows, that is a window by group. Else rows are dealt by ranges of
    (group, order), each range is scanned by itself, and the first group of a range takes over what earlier ranges have of it:
    one row a range. So a group that holds a third of all rows is scanned by as many tasks as it has ranges.
    """
    if not group:
        raise ValueError("a scan over all rows is not one by groups; see running_total")
    if largest is None:
        largest = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= max_group:
        window = Window.partitionBy(*group).orderBy(*order)
        for s in scans:
            df = df.withColumn(s.out, s.whole(window))
        return df
    columns = df.columns
    inside, whole = Window.partitionBy("__range", *group).orderBy(*order), Window.partitionBy("__range").orderBy(*group, *order)
    local = by_ranges(df, [*group, *order]).withColumn("__first", F.row_number().over(whole) == 1).withColumn("__last", F.lead(F.lit(1)).over(whole).isNull())
    for k, s in enumerate(scans):
        local = local.withColumn(f"__own{k}", s.over(inside, s.with_current)).withColumn(f"__part{k}", s.over(inside, True))
    local = written(local)
    parts, keys = range(len(scans)), [F.col(g) for g in group]
    ends = local.filter("__last").select("__range", F.struct(*keys).alias("__end"), *[f"__part{k}" for k in parts])  # a row a range, as all that follows
    upto = Window.partitionBy("__end").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select("__range", "__end", *[s.over_ranges(F.col(f"__part{k}"), upto).alias(f"__upto{k}") for k, s in enumerate(scans)])
    ranges = ends.join(local.filter("__first").select("__range", F.struct(*keys).alias("__begin")), "__range")
    earlier = Window.orderBy("__range")
    known = ranges.select("__range", "__begin", F.lag("__end").over(earlier).alias("__end"), *[F.lag(f"__upto{k}").over(earlier).alias(f"__before{k}") for k in parts])
    known = known.filter(F.col("__begin").eqNullSafe(F.col("__end"))).drop("__end")
    both = local.join(F.broadcast(known.withColumnRenamed("__range", "__at")), (F.col("__range") == F.col("__at")) & F.struct(*keys).eqNullSafe(F.col("__begin")), "left")
    return both.select(*columns, *[s.shown(s.joined(F.col(f"__before{k}"), F.col(f"__own{k}"))).alias(s.out) for k, s in enumerate(scans)])
