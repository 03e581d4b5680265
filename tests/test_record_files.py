"""Record files as a data source: round trips, pushed indices, bytes read, failed tasks, look-ups and merging."""

import os
import struct
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyworks.sources import lz4_games
from plyworks.sources import record_files as rf
from plyworks.sources import records as rec


def rows_of(spark, n, empty_every=7):
    return spark.range(n).select("id", F.when(F.col("id") % empty_every == 3, F.lit(b"")).otherwise(F.encode(F.concat(F.lit("record "), F.col("id").cast("string")), "UTF-8")).alias("record"))


def written(spark, folder, n=200, shards=4, kind="bagz", **options):
    rf.write_files(rows_of(spark, n), f"{folder}/x@.{kind}", order=["id"], shards=shards, **options)
    return f"{folder}/x@{shards}.{kind}"


def text(k):
    return b"" if k % 7 == 3 else f"record {k}".encode()


@pytest.mark.parametrize("kind", ["bag", "bagz"])
@pytest.mark.parametrize("limits", ["inside", "separate"])
def test_round_trip(spark, tmp_path, kind, limits):
    path = written(spark, tmp_path, kind=kind, limits=limits)
    got = rf.read_files(spark, path, limits=limits, rows_per_task=13).orderBy("global_idx").collect()
    assert [(r.global_idx, bytes(r.record)) for r in got] == [(k, text(k)) for k in range(200)]
    assert {r.source_file for r in got} == set(rec.shard_names(path)) and all(r.idx <= r.global_idx for r in got)
    assert not [f for f in os.listdir(tmp_path) if f.startswith("_")]
    old = rec.read_records(spark, path, separate_limits=limits == "separate").collect()  # the files are those of the other reader
    assert sorted(bytes(r.record) for r in old) == sorted(text(k) for k in range(200))


def test_bounds_of_indices_are_pushed(spark, tmp_path):
    path = written(spark, tmp_path)
    df = rf.read_files(spark, path).filter("global_idx >= 20 and global_idx < 23 and length(record) > 0")
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [GreaterThanOrEqual(global_idx,20), LessThan(global_idx,23)]" in plan
    assert not [line for line in plan.splitlines() if line.startswith("Condition") and "global_idx#" in line and (">=" in line or "< 23" in line)]
    assert [(r.global_idx, bytes(r.record)) for r in df.orderBy("global_idx").collect()] == [(k, text(k)) for k in range(20, 23) if text(k)]
    assert rf.read_files(spark, path).filter("global_idx = 1000 or idx < 0").count() == 0
    assert [bytes(r.record) for r in rf.read_files(spark, path).filter(F.col("global_idx").isin(5, 150)).orderBy("global_idx").collect()] == [text(5), text(150)]
    assert rf.read_files(spark, path).filter("idx <= 0").count() == 4


def counted(monkeypatch):
    """Bytes that are read by this process."""
    seen, plain = [0], rf.Place.open

    class Seen:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            self.f.__enter__()
            return self

        def __exit__(self, *a):
            return self.f.__exit__(*a)

        def size(self):
            return self.f.size()

        def read_at(self, n, at):
            seen[0] += n
            return self.f.read_at(n, at)

    monkeypatch.setattr(rf.Place, "open", lambda self, name: Seen(plain(self, name)))
    return seen


def test_a_look_up_reads_one_record(monkeypatch, tmp_path):
    name = str(tmp_path / "one.bagz")
    with open(name, "wb") as f:
        f.write(rec.encode_records([os.urandom(1000) for _ in range(500)]))
    seen = counted(monkeypatch)
    reader = rf._Reader({"path": name, "shared_path": "true"})
    left = list(reader.pushFilters([rf.ds.EqualTo(("global_idx",), 77), rf.ds.IsNotNull(("record",))]))
    assert [type(f) for f in left] == [rf.ds.IsNotNull]
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts] == [(77, 78)] and seen[0] == 8
    (batch,) = reader.read(parts[0])
    assert batch.num_rows == 1 and seen[0] < 1200


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    bad = rows_of(spark, 100).withColumn("record", F.when(F.col("id") < 90, F.col("record")).otherwise(F.expr("cast(assert_true(id < 0) as binary)")))
    with pytest.raises(Exception):  # noqa: B017
        rf.write_files(bad, f"{tmp_path}/y@.bagz", shards=3)
    assert not [f for _, _, names in os.walk(tmp_path) for f in names]
    written(spark, tmp_path, 10, 2)
    with pytest.raises(Exception, match="overwrite"):
        written(spark, tmp_path, 20, 2)
    written(spark, tmp_path, 20, 2, overwrite=True)
    assert rf.read_files(spark, f"{tmp_path}/x@2.bagz").count() == 20


def test_local_paths_are_refused_where_machines_do_not_share_them(tmp_path):
    with pytest.raises(ValueError, match="shared_path"):
        rf._Reader({"path": str(tmp_path / "a.bagz")}).partitions()


def test_local_paths_below_the_folder_that_a_cluster_shares(spark, tmp_path):
    path = written(spark, tmp_path / "shared", 20, 2)
    for kind in (rf._Reader, lambda o: lz4_games._Reader(o)):
        for told in (str(tmp_path / "shared"), f"file://{tmp_path}/shared/"):
            place = getattr(r := kind({"path": path, "shared_path": told}), "place", None) or r.files.place
            assert place.at(f"file:{tmp_path}/shared/x/y.bagz")[1] == f"{tmp_path}/shared/x/y.bagz"
            for outside in (f"{tmp_path}/shared-not/y.bagz", f"{tmp_path}/shared/../y.bagz", "/y.bagz"):
                with pytest.raises(ValueError, match="shared_path"):
                    place.at(outside)
    assert rf.read_files(spark, path, shared_path=str(tmp_path / "shared")).count() == 20
    session = lambda master, folder: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None), conf={"spark.checkpoint.dir": folder} if folder else {})
    told = [rf.session_path(session(*x)) for x in (("local[2]", "/c"), ("spark://m:7077", "file:///c"), ("spark://m:7077", None), ("spark://m:7077", "hdfs://n/c"))]
    assert told == [True, "file:///c", False, False]


def test_index_reads_no_record_and_numbers_all(spark, tmp_path):
    path = written(spark, tmp_path)
    with open(tmp_path / "empty.bagz", "wb"):
        pass
    index = rf.file_index(spark, path, str(tmp_path / "empty.bagz")).orderBy("first").collect()
    sizes = {r.source_file.rsplit("/")[-1]: 0 for r in rec.read_records(spark, path).select("source_file").distinct().collect()}
    for r in rec.with_global_index(rec.read_records(spark, path)).collect():
        sizes[r.source_file.rsplit("/")[-1]] += 1
    assert {r.source_file.rsplit("/")[-1]: r.n for r in index} == {**sizes, "empty.bagz": 0}
    assert sorted((r.first, r["last"]) for r in index if r.n) == [(a, b) for a, b in zip(np.cumsum([0, *[sizes[k] for k in sorted(sizes)]]), np.cumsum([sizes[k] for k in sorted(sizes)]))]
    broken = path.replace("@4", "-00002-of-00004")
    with open(broken, "r+b") as f:  # no record of this file can be decoded any more
        f.write(b"\0" * 20)
    assert sum(r.n for r in rf.file_index(spark, path).collect()) == 200


@pytest.mark.parametrize("kind,limits", [("bagz", "inside"), ("bag", "separate")])
def test_look_up_of_many(spark, tmp_path, kind, limits):
    path = written(spark, tmp_path, kind=kind, limits=limits)
    wanted = spark.createDataFrame([(k, k % 3) for k in [0, 1, 2, 2, 77, 150, 199, 200, -1, 5000]] + [(None, 1)], "i long, x int")
    found = rf.look_up(wanted, rf.file_index(spark, path, limits=limits), column="i", limits=limits)
    assert sorted((r.i, r.x, bytes(r.record)) for r in found.collect()) == sorted((k, k % 3, text(k)) for k in [0, 1, 2, 2, 77, 150, 199])


@pytest.mark.parametrize("kind", ["bag", "bagz"])
@pytest.mark.parametrize("limits", ["inside", "separate"])
@pytest.mark.parametrize("target", ["all", "part@2"])
def test_merge_copies_bytes(spark, tmp_path, kind, limits, target):
    a, b = written(spark, tmp_path / "a", 120, 3, kind, limits=limits), written(spark, tmp_path / "b", 31, 2, kind, limits=limits)
    place, stored = rf.Place(True), []
    for n in [*rec.shard_names(a), *rec.shard_names(b)]:
        f = rf.RecordFile(place, n, limits == "separate")
        body, count = f.layout()
        stored += f.stored(0, count, body)
    new = f"{tmp_path}/m/{target}.{kind}"
    told = rf.merge_files(spark, [a, b], new, limits=limits).collect()
    got = []
    for n in rec.shard_names(new):
        f = rf.RecordFile(place, n, limits == "separate")
        body, count = f.layout()
        got += f.stored(0, count, body)
    assert got == stored and sum(r.records for r in told) == 151 and sum(r["files"] for r in told) == 5
    assert sorted(os.listdir(tmp_path / "m")) == sorted(x for n in rec.shard_names(new) for x in [os.path.basename(n)] + [f"limits.{os.path.basename(n)}"] * (limits == "separate"))
    rows = rf.read_files(spark, new, limits=limits).orderBy("global_idx").collect()
    assert [bytes(r.record) for r in rows] == [text(k) for k in range(120)] + [text(k) for k in range(31)]


def test_merge_decodes_nothing(spark, tmp_path):
    """Bodies that are no zstd frames at all come through, and a mixed list is refused."""
    raw = [b"not", b"", b"a frame"]
    ends = np.cumsum([len(r) for r in raw]).tolist()
    for k in range(2):
        (tmp_path / f"{k}.bagz").write_bytes(b"".join(raw) + struct.pack("<3q", *ends))
    rf.merge_files(spark, [str(tmp_path / "0.bagz"), str(tmp_path / "1.bagz")], str(tmp_path / "all.bagz"))
    f = rf.RecordFile(rf.Place(True), str(tmp_path / "all.bagz"), False)
    assert f.stored(0, 6, f.layout()[0]) == raw + raw
    with pytest.raises(ValueError, match="plain and compressed"):
        rf.merge_files(spark, [str(tmp_path / "0.bagz"), str(tmp_path / "1.bag")], str(tmp_path / "all.bagz"))


def test_path_names_the_files_that_were_written(spark, tmp_path):
    """Two distinct keys make two ranges at most, whatever is asked for."""
    df = spark.createDataFrame([(k % 2, f"r{k % 2}".encode()) for k in range(6)], "k int, record binary")
    path = rf.write_files(df, str(tmp_path / "a@.bagz"), order=["k"], shards=8)
    assert path.endswith(f"a@{len(list(tmp_path.glob('a-*')))}.bagz") and not list(tmp_path.glob("_*"))
    assert [bytes(r.record) for r in rf.read_files(spark, path).orderBy("global_idx").collect()] == [b"r0"] * 3 + [b"r1"] * 3
