"""LZ4 games read by frames and pieces, files that arrive, errors of lines, fixed decimals and positions in parts."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plyworks.sources import games as src
from plyworks.sources import lz4_games as lz
from plyworks.sources import record_files as rf
from plyworks.sources import records as rec
from plyworks.sources import reports

GAME = '[Event "No {0}"]\n[Result "1-0"]\n\n1. e4 {1} e5 1-0\n'


def text_of(n, pad=40):
    return "\n".join(GAME.format(k, "{ " + os.urandom(pad).hex() + " }") for k in range(n)).encode()


def framed(text, size):
    return b"".join(pa.compress(text[a : a + size], "lz4", asbytes=True) for a in range(0, len(text), size))


@pytest.mark.parametrize("size,per_task", [(1 << 20, 1 << 20), (1000, 1), (1000, 3000), (37, 200)])
def test_games_of_many_frames(spark, tmp_path, size, per_task):
    """Games go over the edges of frames and runs, wherever these fall."""
    text = text_of(60)
    (tmp_path / "a.pgn.lz4").write_bytes(framed(text, size))
    (tmp_path / "b.pgn.lz4").write_bytes(framed(text_of(2), size))
    (tmp_path / "empty.lz4").write_bytes(b"")
    files = lz._Files(rf.Place(True), per_task, None)
    name = str(tmp_path / "a.pgn.lz4")
    got = [g for run in files.runs(name) for *_, g in files.rows(run)]
    want = [g if g.startswith("[Event") else f"[Event {g}" for g in text.decode().split("\n[Event ")]
    assert [g.strip() for g in got] == [g.strip() for g in want] and (per_task > 10000 or len(files.runs(name)) > 1)
    if per_task == 3000:
        rows = lz.read_games(spark, str(tmp_path), bytes_per_task=per_task).orderBy("source_file", "at", "no").collect()
        assert [r.pgn.strip() for r in rows][:60] == [g.strip() for g in want] and len(rows) == 62
        first = lz.read_games(spark, str(tmp_path), first_games=1)
        assert sorted(src.with_headers(first).select("event").toPandas()["event"]) == ["No 0", "No 0"]


def test_first_games_read_only_what_they_take(tmp_path):
    text = text_of(3000, 2000)
    (tmp_path / "a.lz4").write_bytes(framed(text, 1 << 18))
    read = [0]

    class Seen:
        def __init__(self, f):
            self.f = f

        def read_at(self, n, at):
            read[0] += n
            return self.f.read_at(n, at)

    with rf.Place(True).open(str(tmp_path / "a.lz4")) as f:
        pieces = ((p, False) for p in lz.decoded(Seen(f), 0, f.size()))
        games = lz.games(pieces, True)
        assert [next(games).count(b"[Event ") for _ in range(3)] == [1, 1, 1] and read[0] < f.size() / 4


def test_frames_are_found_by_their_blocks(tmp_path):
    parts = [pa.compress(text_of(n), "lz4", asbytes=True) for n in (1, 500, 3)]
    (tmp_path / "a.lz4").write_bytes(b"".join(parts))
    with rf.Place(True).open(str(tmp_path / "a.lz4")) as f:
        assert [b - a for a, b in lz.frames(f, f.size())] == [len(p) for p in parts]
    (tmp_path / "b.lz4").write_bytes(b"no frame at all")
    with rf.Place(True).open(str(tmp_path / "b.lz4")) as f, pytest.raises(ValueError, match="no LZ4 frame"):
        list(lz.frames(f, f.size()))


def drained(df, name):
    query = df.writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"/tmp/{name}-{os.urandom(6).hex()}").start()
    query.awaitTermination(120)
    return query


def test_games_that_arrive(spark, tmp_path):
    (tmp_path / "x.pgn").write_text(text_of(5).decode())
    drained(src.with_headers(src.stream_games(spark, str(tmp_path))).select("event"), "plain_games")
    assert sorted(r.event for r in spark.table("plain_games").collect()) == [f"No {k}" for k in range(5)]


def follow(df, spark, name, arrive, want):
    """Rows after each arrival; nothing comes twice."""
    query = df.writeStream.format("memory").queryName(name).start()
    try:
        for step, n in zip(arrive, want):
            step()
            query.processAllAvailable()
            assert spark.table(name).count() == n
    finally:
        query.stop()


def test_lz4_games_that_arrive(spark, tmp_path):
    put = lambda name, n: (lambda: (tmp_path / name).write_bytes(framed(text_of(n), 500)))
    follow(lz.stream_games(spark, str(tmp_path)).select("pgn"), spark, "lz4_stream", [put("a.lz4", 4), put("b.lz4", 3), put("ignored.txt", 9)], [4, 7, 7])


def test_record_files_that_arrive(spark, tmp_path):
    put = lambda name, n: (lambda: (tmp_path / name).write_bytes(rec.encode_records([b"x%d" % k for k in range(n)])))
    follow(rf.stream_files(spark, str(tmp_path)).select("record"), spark, "record_stream", [put("a.bagz", 4), put("b.bagz", 3)], [4, 7])


def test_lines_that_are_wrong_are_counted(spark, tmp_path):
    lines = ['{"fen":"a","moves":{"e2e4":5}}', "{not json", "also not", '{"moves":{"e2e4":5}}', '{"fen":"b"}', ""]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    got = {r.reason: (r.lines, r.examples) for r in rec.moves_errors(spark, str(tmp_path)).collect()}
    assert got == {"no JSON of this kind": (2, ["also not", "{not json"]), "no position": (1, [""]), "no moves": (1, ["b"])}
    assert [(r.fen, r.moves) for r in rec.read_moves_jsonl(spark, str(tmp_path)).orderBy("fen").collect()] == [("a", {"e2e4": 5}), ("b", None)]


def test_fixed_decimals(spark):
    df = spark.createDataFrame([('a "q"\\', 1.5, 2.25, [1, 2]), ("b", None, 1e-7, None)], "s string, x double, y double, l array<int>")
    got = sorted(bytes(r.record).decode() for r in rec.fixed_json_records(df, {"x": 6, "y": 1}).collect())
    assert got == ['{"s":"a \\"q\\"\\\\","x":1.500000,"y":2.3,"l":[1,2]}', '{"s":"b","y":0.0}'] or got == ['{"s":"a \\"q\\"\\\\","x":1.500000,"y":2.2,"l":[1,2]}', '{"s":"b","y":0.0}']


def test_a_position_on_half_of_all_records_comes_in_parts(spark):
    rows = [("hot w - - 0 1" if k % 2 else f"p{k % 5} w - - 0 {k}", ["e2e4"], float(k % 97), 1.0, 2.0, 0.0, 1500 + k % 3) for k in range(1000)]
    df = spark.createDataFrame(rows, "fen string, recent_moves array<string>, thinking_time double, player_clock double, opponent_clock double, increment double, rating int")
    for history in (False, True):
        parts = reports.position_parts(df, with_history=history, part_rows=60, max_group=50)
        assert parts.agg(F.max(F.size("thinking_times"))).first()[0] == 60 and parts.filter("part = 8").count() == 1
        whole = sorted(map(tuple, reports.grouped_clock_records(df, with_history=history).collect()))
        assert sorted(map(tuple, reports.merged_parts(parts).collect())) == whole
