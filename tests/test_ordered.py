"""Order over whole tables against plain Python, with ties, nulls, hot values and few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyworks.operators import aggregates as agg
from plyworks.operators import ordered
from plyworks.operators import sequences as seq


def table(spark, n=400):
    rng = np.random.default_rng(0)
    rows = [(i, "abc"[int(rng.integers(3))] if rng.random() > 0.1 else None, float(rng.choice([5.0, 5.0, 5.0, rng.integers(0, 50)])) if rng.random() > 0.05 else None, int(rng.integers(0, 4))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, k string, v double, w int")


def no_single_task(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Window" not in plan or "SinglePartition" not in plan.split("Window", 1)[1].split("Scan", 1)[0]


def test_row_numbers_and_tiles(spark):
    rows, df = table(spark)
    key = lambda r: (r[2] is not None, r[2] or 0, r[0])
    want = {r[0]: k for k, r in enumerate(sorted(rows, key=key), 1)}
    got = ordered.row_numbers(df, ["v", "id"])
    assert no_single_task(got) and {r.id: r.row for r in got.collect()} == want
    for n in (1, 7, 399, 500):
        size, longer = divmod(len(rows), n)
        tile = {i: (k - 1) // (size + 1) + 1 if k <= longer * (size + 1) else longer + (k - 1 - longer * (size + 1)) // max(size, 1) + 1 for i, k in want.items()}
        assert {r.id: r.t for r in ordered.tiles(df, ["v", "id"], n, "t").collect()} == tile
    assert ordered.row_numbers(df.limit(0), ["v", "id"]).count() == 0
    down = {r.id: r.row for r in ordered.row_numbers(df, [F.desc("id")]).collect()}
    assert down[399] == 1 and down[0] == 400


def test_percentiles(spark):
    rows, df = table(spark)
    points = {"low": 0.0, "p30": 0.3, "mid": 0.5, "p99": 0.99, "top": 1.0}
    got = ordered.percentiles(df, "v", points, "k")
    for r in got.collect():
        v = [x[2] for x in rows if x[1] == r.k and x[2] is not None]
        assert [r[p] for p in points] == pytest.approx([np.quantile(v, q) for q in points.values()])
    assert no_single_task(got) and {r.k for r in got.collect()} == {"a", "b", "c", None}
    v = [x[2] for x in rows if x[2] is not None for _ in range(x[3])]
    r = ordered.percentiles(df, "v", points, weight="w").first()
    assert [r[p] for p in points] == pytest.approx([np.quantile(v, q) for q in points.values()])
    assert ordered.percentiles(df.limit(0), "v", points).count() == 0 and ordered.percentiles(df.filter("v is null"), "v", points, "k").count() == 0


def test_auc_and_calibration(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.integers(0, 12)) / 12, int(rng.random() < 0.3)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, p double, y int")
    pos, neg = [p for _, p, y in rows if y], [p for _, p, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert agg.auc(df, "p", "y").first().auc == pytest.approx(want)
    assert agg.auc(df.filter("y = 1"), "p", "y").first().auc is None
    assert [r.n for r in agg.calibration(df, "p", "y", ["id"], 7).orderBy("bin").collect()] == [72] * 3 + [71] * 4
    assert agg.calibration(df, "p", "y", ["id"]).agg(F.sum("n")).first()[0] == 500


def test_bounds_pass_over_narrow_steps(spark):
    """Steps of the tail that are narrower than the even ones neither extend the even part nor end it."""
    times = spark.createDataFrame([(float(v),) for v in [1, 3, 5, 7, 9] * 20 + [10, 11, 12, 14, 16, 40, 60, 90] * 40], "t double")
    bounds = agg.linear_then_equal_bounds(times, "t", 12, 10.0, 2.0)
    assert bounds[:6] == [0.0, 2.0, 4.0, 6.0, 8.0, 10.0] and bounds[-1] == float("inf") and bounds == sorted(set(bounds))


def test_seeded_order_is_the_same_at_any_parallelism(spark):
    df = spark.range(500).select(F.col("id").alias("k"))
    a = {r.k: r.place for r in seq.seeded_rank(df, 4, "k").collect()}
    b = {r.k: r.place for r in seq.seeded_rank(df.repartition(13), 4, "k").collect()}
    assert a == b and sorted(a.values()) == list(range(1, 501)) and a != {r.k: r.place for r in seq.seeded_rank(df, 5, "k").collect()}
    assert [r.k for r in seq.seeded_sample(df, 5, 4, "k").collect()] == sorted(a, key=a.get)[:5]
