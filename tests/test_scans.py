"""Scans of hot groups by ranges, joins with tables of intervals, weighted races and the cascade, against plain versions."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyworks.operators import joins, ordered
from plyworks.operators import sequences as seq
from plyworks.operators.ordered import Scan, scan
from plyworks.plans import serving


def hot_rows(spark, n=4000, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(k), None if g == 9 else int(g), None if v < 0.2 else float(int(v * 100)), "ab"[int(v * 10) % 2]) for k, g, v in zip(rng.permutation(n), np.where(rng.random(n) < 0.6, 1, rng.integers(0, 10, n)), rng.random(n))]
    return spark.createDataFrame(rows, "k long, g int, v double, side string").repartition(7)


def scans_of():
    return [Scan("total", "sum", F.col("v")), Scan("before", "max", F.col("v"), with_current=False), Scan("known", "last", F.col("v")), Scan("five", "rows", F.col("v"), 5), Scan("three", "rows", F.col("side"), 3, with_current=False)]


@pytest.mark.parametrize("down", [False, True])
def test_ranges_give_what_windows_give(spark, down):
    df, order, scans = hot_rows(spark), [F.col("k").desc() if down else "k"], scans_of()
    plain = sorted(map(tuple, scan(df, ["g"], order, *scans).collect()), key=str)
    assert sorted(map(tuple, scan(df, ["g"], order, *scans, max_group=100).collect()), key=str) == plain
    assert sorted(map(tuple, scan(df.limit(0), ["g"], order, *scans, max_group=0).collect()), key=str) == []


def test_no_task_has_more_than_a_range_of_a_hot_group(spark):
    df = hot_rows(spark, 20000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = ordered.by_ranges(df, ["g", "k"]).groupBy("__range").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 8000  # of 12,000 rows of the hot group


def test_operators_on_hot_groups(spark):
    df = hot_rows(spark).filter("v is not null")
    both = lambda f: (sorted(map(tuple, f().collect()), key=str), sorted(map(tuple, f(max_group=50).collect()), key=str))
    for plain, hot in (
        both(lambda **o: seq.history(df, "g", "k", "side", 12, "h", with_current=False, **o)), both(lambda **o: seq.new_maxima(df, "g", ["k"], "v", **o)),
        both(lambda **o: seq.thinking_time(df, ["g", "side"], "k", "v", F.lit(2.0), F.lit(300.0), "t", **o)), both(lambda **o: seq.running(df, "g", ["k"], "v", "t", "m", **o)),
        both(lambda **o: joins.last_known_of_other(df.withColumn("side", F.translate("side", "ab", "wb")), "g", "k", "side", "v", 300.0, "other", **o)),
        both(lambda **o: seq.rolling_mean(df, "g", ["k"], "v", 6, "m", **o)), both(lambda **o: seq.weighted_choice(df.groupBy("g", "k").agg(F.first("v").alias("v")), "g", "k", "v", 3, **o)),
    ):
        assert plain == hot and plain


def test_groups_with_a_bad_row_go(spark):
    df = spark.createDataFrame([(1, True), (1, False), (2, False), (None, False), (None, True), (3, None)], "g int, bad boolean")
    assert sorted(r.g for r in seq.drop_groups_with(df, "g", F.col("bad")).collect()) == [2, 3]
    assert sorted(r.g for r in seq.drop_groups_with(df, "g", F.col("bad"), largest=10).collect()) == [2, 3]


# intervals


def interval_tables(spark):
    rng = np.random.default_rng(3)
    starts = np.sort(rng.choice(40000, 1500, replace=False))
    bands = [(int(a), int(min(a + w, b)), f"n{k}") for k, (a, b, w) in enumerate(zip(starts, np.append(starts[1:], 50000), rng.integers(0, 40, 1500)))]
    values = [None, -5, 60000, *[int(x) for x in rng.integers(-10, 50010, 3000)], *[int(starts[700])] * 2000]
    return bands, spark.createDataFrame(bands, "lo long, hi long, name string"), values, spark.createDataFrame(list(enumerate(values)), "id long, v long")


def test_interval_joins(spark):
    bands, table, values, points = interval_tables(spark)
    df = joins.in_intervals(points, "v", table, "lo", "hi")
    assert not any(x in df._jdf.queryExecution().toString() for x in ("NestedLoop", "Cartesian"))
    real = [b for b in bands if b[0] < b[1]]
    starts = np.array([b[0] for b in real])

    def held(v):
        k = np.searchsorted(starts, v, "right") - 1 if v is not None else -1
        return real[k][2] if k >= 0 and v < real[k][1] else None

    assert sorted((r.id, r.name) for r in df.collect()) == [(i, held(v)) for i, v in enumerate(values)]
    gap = lambda v, b: b[0] - v if v < b[0] else v - b[1] + 1 if v >= b[1] else 0
    near = joins.nearest_interval(points, "v", table, "lo", "hi", "name", "model", "d")
    assert not any(x in near._jdf.queryExecution().toString() for x in ("NestedLoop", "Cartesian"))
    got = {r.id: (r.model, r.d) for r in near.collect()}
    for i, v in enumerate(values):
        k = 0 if v is None else np.searchsorted(starts, v, "right")
        best = (None, None) if v is None else min(((gap(v, b), b[0], b[2]) for b in real[max(k - 2, 0) : k + 2]))[::2][::-1]
        assert got[i] == best
    empty = table.filter("false")
    assert {r.name for r in joins.in_intervals(points, "v", empty, "lo", "hi").collect()} == {None}
    assert {r.model for r in joins.nearest_interval(points, "v", empty, "lo", "hi", "name", "model", "d").collect()} == {None}


def test_registry_of_any_size(spark):
    names = spark.createDataFrame([(f"{k * 100}_{k * 100 + 50}",) for k in range(500)] + [("other",), ("1_2_3",), ("a_5",)], "name string")
    table = serving.registry_table(names)
    assert table.count() == 500
    asked = spark.createDataFrame([(k,) for k in (0, 49, 50, 74, 75, 76, 99, 100, 99999)], "rating long")
    short = serving.registry_bands([r.name for r in names.collect()])
    plain = {(r.rating, r.model, r.distance) for r in serving.nearest_model(asked, short).collect()}
    assert {(r.rating, r.model, r.distance) for r in serving.nearest_registered(asked, table).collect()} == plain


# draws


def test_races_draw_in_proportion(spark):
    weights = {0: 1.0, 1: 2.0, 2: 5.0, 3: 0.0, 4: -1.0}
    df = spark.range(6000).select(F.col("id").alias("g"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in weights.items()])).alias("x")).select("g", "x.i", "x.w")
    one = Counter(r.i for r in seq.weighted_draw(df, "g", "i", "w", 4).collect())
    assert set(one) == {0, 1, 2} and all(abs(one[i] / 6000 - weights[i] / 8) < 0.02 for i in one)
    two = seq.weighted_draws(df, "g", "i", "w", 2, 4)
    pairs = Counter(tuple(r.i) for r in two.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "i"))), lambda x: x["i"]).alias("i")).collect())
    for (a, b), n in pairs.items():
        assert a != b and abs(n / 6000 - weights[a] / 8 * weights[b] / (8 - weights[a])) < 0.02
    plan = seq.weighted_draw(df, "g", "i", "w", 4)._jdf.queryExecution().toString()
    assert "partial_min" in plan  # combined before the shuffle
    assert seq.weighted_draws(df, "g", "i", "w", 9, 4).count() == 18000


def test_seeded_buckets_and_shuffles(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    dealt = seq.seeded_buckets(df, 8, 5, "k").select("k", F.spark_partition_id().alias("p"), seq.seeded_place(5, "k").alias("h")).collect()
    parts = [[r.h for r in dealt if r.p == p] for p in range(8)]
    assert sorted(r.k for r in dealt) == list(range(3000)) and all(p == sorted(p) for p in parts) and min(map(len, parts)) > 250
    again = seq.seeded_buckets(df.repartition(3), 8, 5, "k").select("k", F.spark_partition_id().alias("p")).collect()
    assert [(r.k, r.p) for r in again] == [(r.k, r.p) for r in dealt]
    other = seq.seeded_buckets(df, 8, 6, "k").select("k").collect()
    assert [r.k for r in other] != [r.k for r in dealt]


# cascade


def test_cascade_is_one_join(spark):
    table = lambda rows: spark.createDataFrame(rows, "key string, v long")
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "y"), (4, None, None), (4, None, None), (5, "c", "z")], "id int, p string, q string")
    steps = [("first", table([("a", 10), ("c", None)]), "p", "v"), ("second", table([("x", 20), ("y", 30)]), "q", "v"), ("third", table([("c", 40), ("b", 50)]), "p", "v")]
    found = joins.cascade(df, steps, "out", "why")
    assert sorted(map(tuple, found.select("id", "out", "why").collect()), key=str) == sorted([(1, 10, "first"), (2, 20, "second"), (3, 30, "second"), (4, None, "not found"), (4, None, "not found"), (5, 40, "third")], key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_clocks_of_a_review(spark):
    rows = [(1, 1, "w", 180.0), (1, 2, "b", None), (1, 3, "w", None), (1, 4, "b", 170.0), (2, 1, "b", 9.0)]
    df = spark.createDataFrame(rows, "game_id long, ply int, side string, clk double")
    for most in (100, 1):
        got = sorted((r.game_id, r.ply, r.white_clock, r.black_clock) for r in serving.clocks_at(df, max_group=most).collect())
        assert got == [(1, 1, 180.0, None), (1, 2, 180.0, None), (1, 3, 180.0, None), (1, 4, 180.0, 170.0), (2, 1, None, 9.0)]


def test_shares_need_no_window(spark):
    from plyworks.operators import aggregates as agg

    df = spark.createDataFrame([(k % 3,) for k in range(10)], "k int")
    assert {r.k: round(r.share, 9) for r in agg.shares(df, "k").collect()} == {0: 0.4, 1: 0.3, 2: 0.3}
    assert "Window" not in agg.class_weights(df, "k")._jdf.queryExecution().toString()
    assert math.isclose(sum(r.weight for r in agg.class_weights(df, "k").collect()) / 3, 1)
