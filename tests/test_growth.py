"""What a task holds and how often a step is worked out, where tables grow."""

import tracemalloc

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from plyworks import catalog, catalog_games
from plyworks.functions import board
from plyworks.operators import joins
from plyworks.plans import records, serving
from plyworks.sources import record_files as rf
from plyworks.sources import records as rec
from plyworks.streaming import ratings


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_task_holds_the_plies_of_few_games_at_a_time():
    texts = ["1. e4 {[%clk 0:01:00]} e5", None, "", "1. e5"] * 200
    parts = list(records._replayed.func(iter([pa.array(texts)])))
    assert len(parts) > 1 and max(map(len, parts)) <= 256
    games = [g for p in parts for g in p.to_pylist()]
    assert games == [[dict(zip(records._PLY.fieldNames(), p)) for p in board.replay(t)] for t in texts]


def test_a_task_holds_few_plies_at_a_time_of_long_games():
    texts = [" ".join(["Nf3 Nf6 Ng1 Ng8"] * n) for n in (600, 0, 1, 700, 500, 300, 2500, 2, 600)]
    parts = list(records._replayed.func(iter([pa.array(texts), pa.array(texts[:2])])))
    held = [[len(g) for g in p.to_pylist()] for p in parts]
    assert [n for p in held for n in p] == [len(t.split()) for t in texts + texts[:2]]
    assert len(held) > 2 and all(sum(p[:-1]) < 8_192 for p in held)  # but for the game that ends a part


def test_what_replaying_holds_does_not_grow_with_the_games(spark, data, monkeypatch):
    seen, plain = [], records.plies
    monkeypatch.setattr(records, "plies", lambda games: seen.append(games) or plain(games))
    catalog.g09_replayed_games(spark, data)
    texts = [r.movetext for r in seen[0].collect()]

    def most(n):
        tracemalloc.start()
        try:
            found = sum(len(part) for part in records._replayed.func(iter([pa.array((texts * (n // len(texts) + 1))[:n])])))
            return found, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    most(500)  # what is looked up by text is kept once
    (few, at_first), (many, later) = most(500), most(4_000)
    assert (few, many) == (500, 4_000) and later < 1.5 * at_first


def test_a_ply_is_played_once_and_looks_at_no_other_piece(monkeypatch):
    seen, plain = [], board.Position.after
    monkeypatch.setattr(board.Position, "after", lambda self, move: seen.append(move) or plain(self, move))
    monkeypatch.setattr(board.Position, "_candidates", None)
    assert [p[3] for p in board.replay("1. Nf3 Nc6 2. e4 e5 3. Bb5")] == ["g1f3", "b8c6", "e2e4", "e7e5", "f1b5"] and len(seen) == 5


def test_clocks_are_read_once_a_ply(spark):
    found = records.plies(spark.createDataFrame([(1, "1. e4 {[%clk 0:01:02]} e5 {[%clk x]} 2. d4 {[%clk 7]}")], "game_id long, movetext string"))
    assert [r.clk for r in found.orderBy("ply").collect()] == [62.0, None, 7.0]
    assert plan(found).count("regexp_extract") == 1


def test_ids_of_moves_are_looked_up_before_histories(spark, data):
    above, below = plan(catalog_games.g15_history_tokens(spark, data)).split("Window [", 1)
    assert "e2" not in above and "e2" in below


def test_plies_that_no_row_needs_are_gone_before_the_window(spark, data):
    above, below = plan(catalog_games.g17_sql_functions(spark, data)).split("Window [", 1)
    assert "<= 12" not in above and "<= 12" in below


def test_folds_make_no_table_of_a_key(spark, monkeypatch):
    rows = [(f"u{k % 50}", k, 86_400 * k, 1500.0 + k, 50.0, (k % 3) / 2) for k in range(300)] + [(None, 1, 0, 1500.0, 50.0, 1.0)]
    games = spark.createDataFrame(rows, "user_id string, game_no long, played_at long, opponent_rating double, opponent_rd double, score double")
    rated = games.withColumnRenamed("user_id", "player")
    matches = games.select(F.col("user_id").alias("match_id"), "game_no", F.lit("a").alias("white"), F.lit("b").alias("black"), "score")
    frame = lambda key: games.filter(f"user_id = '{key}'").toPandas()
    with_games = {"u7": frame("u7"), "u8": frame("u8")}
    for made, key, fold, start in ((ratings.rate_games(rated), "player", ratings._fold, (*ratings.START, 0)), (ratings.user_history(games), "user_id", ratings._user_fold, ratings.USER_START)):
        assert "MapInArrow" in plan(made) and made.count() == 301
        for k, part in with_games.items():
            wanted = fold(k, part.sample(frac=1, random_state=1), start)[0]
            pd.testing.assert_frame_equal(made.filter(F.col(key) == k).orderBy("game_no").toPandas(), wanted, check_dtype=False)
    found = ratings.rate_matches(matches)
    assert "MapInArrow" in plan(found) and found.count() == 301
    first = found.groupBy("match_id").agg(F.min_by("white_rating", "game_no").alias("r"), F.min_by("black_rating", "game_no").alias("b")).collect()
    assert len(first) == 51 and all(abs(r.r + r.b - 3000) < 1e-6 for r in first)  # each match begins anew


def test_a_cascade_multiplies_no_row(spark):
    asked = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (2, "b", 2), (3, None, 3), (4, "c", None)], "id int, k string, n int")
    by_k = spark.createDataFrame([("a", 10), ("b", None), (None, 99)], "key string, v int")
    by_n = spark.createDataFrame([(1, 20), (2, 21), (None, 98)], "key int, v int")
    found = joins.cascade(asked, [("first", by_k, "k", "v"), ("second", by_n, "n", "v")], "v", "why")
    assert sorted(tuple(r)[0:1] + tuple(r)[3:] for r in found.collect()) == [(1, 10, "first"), (2, 21, "second"), (2, 21, "second"), (3, None, "not found"), (4, None, "not found")]
    assert found.columns == ["id", "k", "n", "v", "why"] and not [x for x in ("Generate", "Aggregate") if x in plan(found)]


def test_a_draw_meets_the_values_of_its_slot(spark):
    """As a search through all values, also where many share a slot, one has many, or none has a weight."""
    maps = {0: {str(k): float(k % 7) for k in range(3000)}, 1: {"5": 1e9, "6": 1.0}, 2: {"1": 0.0}, 3: {"4": 3.0}}
    per = spark.createDataFrame(list(maps.items()), "bucket int, distribution map<string,double>")
    asked = spark.range(2000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 9 < 5, F.col("id") % 5).cast("int").alias("bucket"))
    drawn = serving.draw_seconds(asked, "event_id", "bucket", per, 5)
    assert "filter(" not in plan(drawn)
    units = {r.event_id: r.u for r in asked.select("event_id", serving.num.seeded_unit(5, F.col("event_id")).alias("u")).collect()}
    rows = drawn.collect()
    assert len(rows) == 2000
    for r in rows:
        items, upto, wanted = sorted((float(k), w) for k, w in maps.get(r.bucket, {}).items()), 0.0, None
        mark = units[r.event_id] * sum(w for _, w in items)
        for value, w in items:
            upto += w
            if upto > mark:
                wanted = value
                break
        assert r.seconds == wanted


def test_ranges_of_intervals_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "RANGE_ROWS", 100)
    points = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, 700).otherwise(F.col("id")).alias("v"))
    bands = spark.range(300).select((F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 4).alias("hi"), F.col("id").alias("name"))
    asked = []
    plain = joins.by_ranges
    monkeypatch.setattr(joins, "by_ranges", lambda df, order, ranges=None: asked.append(ranges) or plain(df, order, ranges))
    found = joins.in_intervals(points, "v", bands, "lo", "hi").collect()
    assert asked == [33] and len(found) == 3000 and all(r.name == (r.v // 10 if r.v % 10 < 4 else None) for r in found)
    near = joins.nearest_interval(points, "v", bands, "lo", "hi", "name", "near", "far").collect()
    assert asked == [33, 33] and len(near) == 3000 and all(r.far == 0 and r.near == r.v // 10 for r in near if r.v % 10 < 4)


def test_a_dump_reads_its_range_and_takes_no_file_whole(spark, data):
    df = catalog_games.q91_record_dump(spark, data)
    explained = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [GreaterThanOrEqual(global_idx,100), LessThan(global_idx,600)]" in explained
    assert not [x for x in ("binaryFile", "Generate", "Aggregate", "Join", "Exchange") if x in explained]


def test_records_are_read_by_ranges_and_numbered_where_they_are(spark, tmp_path):
    rows = spark.range(300).select("id", F.encode(F.concat(F.lit("record "), F.col("id").cast("string")), "UTF-8").alias("record"))
    path = rf.write_files(rows, f"{tmp_path}/x@.bagz", order=["id"], shards=3)
    want = [(k, f"record {k}".encode()) for k in range(300)]
    for named in (path, str(tmp_path), f"{tmp_path}/x-*.bagz"):  # a folder's files and those of a pattern come whole, and are unpacked bit by bit
        df = rec.with_global_index(rec.read_records(spark, named))
        assert [(r.global_idx, bytes(r.record)) for r in df.orderBy("global_idx").collect()] == want
        executed = df._jdf.queryExecution().executedPlan().toString()
        assert ("binaryFile" in executed) == (named != path) and "Generate" not in executed and "SortMergeJoin" not in executed


def test_what_unpacking_holds_does_not_grow_with_the_file(tmp_path):
    def most(n):
        content = rec.encode_records([f"record {k}".encode() for k in range(n)])
        (tmp_path / f"{n}.bagz").write_bytes(content)
        reader = rf._Reader({"path": str(tmp_path / f"{n}.bagz"), "shared_path": "true"})
        whole = pa.RecordBatch.from_arrays([pa.array(["a.bagz"]), pa.array([content]), pa.array([None], pa.binary())], names=["source_file", "content", "limits"])
        out = []
        for batches in (lambda: rec._unpacked(iter([whole])), lambda: (b for p in reader.partitions() for b in reader.read(p))):
            before = pa.total_allocated_bytes()
            tracemalloc.start()
            try:
                found = held = 0
                for b in batches():
                    found, held = found + b.num_rows, max(held, pa.total_allocated_bytes() - before)
                out.append((found, held + tracemalloc.get_traced_memory()[1]))
            finally:
                tracemalloc.stop()
        return out

    most(500)
    for (few, at_first), (many, later) in zip(most(10_000), most(60_000)):
        assert (few, many) == (10_000, 60_000) and later < 1.5 * at_first


def test_sets_are_numbered_by_their_files_sizes(spark, data):
    df = catalog_games.q92_record_sets(spark, data)
    executed = df._jdf.queryExecution().executedPlan().toString()
    assert executed.count("BatchScan record_files") == 3 and not [x for x in ("binaryFile", "Generate", "Aggregate", "Join", "Exchange", "Window") if x in executed]
    n = spark.read.parquet(f"{data}/events.parquet").count()
    assert sorted(map(tuple, df.select("dataset", "global_idx").collect())) == [(k // n, k) for k in range(3 * n)]


def test_a_set_goes_on_where_the_one_before_ends(spark, tmp_path):
    rows = lambda n: spark.range(n).select("id", F.when(F.col("id") % 7 == 3, F.lit(b"")).otherwise(F.encode(F.concat(F.lit("record "), F.col("id").cast("string")), "UTF-8")).alias("record"))
    text = lambda k: b"" if k % 7 == 3 else f"record {k}".encode()
    (tmp_path / "none.bagz").write_bytes(b"")
    apart = rf.write_files(rows(30), f"{tmp_path}/b@.bag", order=["id"], shards=2, limits="separate")
    sets = [(rf.write_files(rows(50), f"{tmp_path}/a@.bagz", order=["id"], shards=3), "inside"), (f"{tmp_path}/none.bagz", "inside"), (apart, "separate"), (apart, "separate")]
    df = rf.read_sets(spark, sets, rows_per_task=11)
    want = [(s, g, text(k)) for g, (s, k) in enumerate([(0, k) for k in range(50)] + [(s, k) for s in (2, 3) for k in range(30)])]
    got = lambda d: [(r.dataset, r.global_idx, bytes(r.record)) for r in d.orderBy("global_idx").collect()]
    assert got(df) == want and df.columns == ["dataset", "source_file", "idx", "global_idx", "record"]
    assert got(df.filter("global_idx >= 48 and global_idx < 82")) == want[48:82] and got(df.filter("global_idx = 110")) == []
    assert got(df.filter("dataset = 3 and global_idx < 82")) == want[80:82]
