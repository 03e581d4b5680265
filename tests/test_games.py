import json

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from plyworks.functions import glicko2, numeric
from plyworks.functions import text as tx
from plyworks.functions.board import Position, replay
from plyworks.plans import records
from plyworks.sources import games as src
from plyworks.sources import records as rec

PGN = '[Event "Club"]\n[Result "1-0"]\n[WhiteElo "1750"]\n[BlackElo "1723"]\n[TimeControl "180+2"]\n[Termination "Normal"]\n\n1. e4 { [%clk 0:02:58] } e5 { [%clk 0:02:57] } { a mid-line [Event ] } 1-0\n\n'
OTHER = PGN.replace("Club", "Open").replace("1750", "?").replace("1-0", "*")


def perft(pos, depth):
    return 1 if depth == 0 else sum(perft(pos.after(m), depth - 1) for m in pos.moves())


@pytest.mark.parametrize("fen,depth,nodes", [
    ("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", 3, 8902),
    ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", 2, 2039),
    ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", 3, 2812),
    ("r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1", 2, 264),
])
def test_published_node_counts(fen, depth, nodes):
    assert perft(Position(fen), depth) == nodes


def test_replay_promotion_castling_passant_and_stop():
    assert [m[3] for m in replay("1. e4 d5 2. e5 f5 3. exf6")][-1] == "e5f6"
    assert replay("1. e4 e5 2. Ke3 Nf6")[-1][3] == "e7e5"
    assert replay("1. a4 h5 2. a5 h4 3. a6 h3 4. axb7 hxg2 5. bxa8=Q gxh1=N")[-2][3] == "b7a8q"
    assert replay(None) == [] and replay("*") == []
    assert Position("7k/5Q2/6K1/8/8/8/8/8 b - - 0 1").outcome() == "stalemate"
    ends = {"8/8/4k3/8/8/3K4/8/8": "insufficient", "8/8/4k3/8/8/3KN3/8/8": "insufficient", "8/8/4k1b1/8/8/3KB3/8/8": None, "8/8/4kb2/8/8/3KB3/8/8": "insufficient", "8/8/4k1n1/8/8/3KN3/8/8": None, "8/8/4k3/8/8/3K3P/8/8": None}
    assert {f: Position(f + " w - - 0 1").outcome() for f in ends} == ends
    # a pinned piece is no candidate, and two that may move need a file
    assert replay("1. e4 e5 2. Nf3 Nc6 3. Nc3 Nf6 4. Nd5 Nd4")[-1][3] == "c6d4" and Position("4k3/8/8/8/4r3/8/4N3/4K1N1 w - - 0 1").find("Nf3") == (6, 21, "")
    assert Position("4k3/8/8/8/8/8/8/R3K2R w KQ - 0 1").find("Rd1")[0] == 0 and Position("4k3/8/8/8/8/8/8/R4K1R w - - 0 1").find("Rg1")[0] == 7


def test_glicko2_worked_example():
    rating, rd, vol = glicko2.update(1500, 200, 0.06, [(1400, 30, 1), (1550, 100, 0), (1700, 300, 0)])
    assert abs(rating - 1464.05) < 0.1 and glicko2.shown(rating) == 1464 and abs(rd - 151.52) < 0.01 and abs(vol - 0.05999) < 1e-4
    assert glicko2.shown(412.0) == 600


def test_glicko2_rules_of_the_list():
    same, rd, vol = glicko2.update(1500, 200, 0.06, [])
    assert (same, vol) == (1500, 0.06) and rd == pytest.approx((200**2 + (0.06 * 173.7178) ** 2) ** 0.5)
    assert glicko2.update(1500, 200, 0.06, [], idle=4.0)[1] == pytest.approx((200**2 + 4 * (0.06 * 173.7178) ** 2) ** 0.5)
    assert glicko2.update(1500, 490, 0.06, [], idle=50.0)[1] > 490  # no limit
    game = [(1500, 60, 1)]
    assert glicko2.update(1500, 100, 0.06, game, idle=9.0)[1] > glicko2.update(1500, 100, 0.06, game)[1]
    assert glicko2.update(1500, 100, 0.06, game, played=28)[2] > 0.05 == glicko2.update(1500, 100, 0.06, game, played=29)[2]
    assert glicko2.update(1500, 251, 0.06, game, played=40)[2] > 0.05


def test_read_games_plain_and_zst(spark, tmp_path):
    (tmp_path / "a.pgn").write_text(PGN + OTHER)
    (tmp_path / "b.pgn").write_bytes((PGN + OTHER).replace("\n", "\r\n").encode())
    (tmp_path / "c.pgn.zst").write_bytes(zstandard.compress(PGN.encode()))
    got = src.with_headers(src.read_games(spark, str(tmp_path), "[a]*.pgn")).collect()
    assert [(r.event, r.white_elo, r.initial_time, r.increment) for r in got] == [("Club", 1750, 180.0, 2.0), ("Open", None, 180.0, 2.0)]
    assert src.read_games(spark, str(tmp_path), "*.zst").count() == 1


def test_lz4_frame(spark, tmp_path):
    pack = lambda raw: pa.compress(raw, "lz4", asbytes=True)
    body = PGN.encode() * 1000
    assert src.lz4_frames(pack(body) + pack(b"second")) == body + b"second"
    assert len(src.lz4_frames(pack(body), lambda out: len(out) >= 250, step=100)) == 300
    (tmp_path / "x.pgn.lz4").write_bytes(pack("".join(PGN.replace("Club", f"No {k}") for k in range(50)).encode()))
    assert src.read_lz4_games(spark, str(tmp_path)).count() == 50
    first = src.with_headers(src.read_lz4_games(spark, str(tmp_path), first_games=3)).collect()
    assert [r.event for r in first] == ["No 0", "No 1", "No 2"]


def plies(spark):
    rows = [(1, 1750, 1723, "1-0", "Normal", 180.0, 2.0, "1. e4 { [%clk 0:02:58] } e5 { [%clk 0:02:57] } 2. Nf3 Nc6 { [%clk 0:02:50] }"), (2, 1500, 1500, "0-1", "Normal", 60.0, 0.0, "1. e4 {[%clk 50]} e5 {[%clk 50]} 2. d4 {[%clk 55]}")]
    return records.plies(spark.createDataFrame(rows, "game_id long, white_elo int, black_elo int, result string, termination string, initial_time double, increment double, movetext string"))


def test_clock_records(spark):
    got = sorted(records.clock_records(plies(spark)).collect(), key=lambda r: (r.game_id, r.ply))
    assert [(r.rating, r.player_clock, r.opponent_clock, r.thinking_time, list(r.recent_moves)) for r in got[:2]] == [(1750, 180.0, 180.0, 4.0, ["e2e4"]), (1723, 180.0, 178.0, 5.0, ["e2e4", "e7e5"])]
    assert {r.game_id for r in got} == {1}  # the other game's clock rose without increment


def test_winner_records_and_common_positions(spark):
    won = records.winner_records(plies(spark)).filter("game_id = 1").orderBy("ply").collect()
    assert (won[0].white_clock, won[0].black_clock, won[0].winner) == (178.0, 180.0, 1)
    common = records.common_positions(records.move_observations(plies(spark)), 1).collect()
    assert {tuple(sorted(r.moves.items())) for r in common} >= {(("e2e4", 2),), (("e7e5", 2),)}


def test_record_files(spark, tmp_path):
    items = [b"alpha", b"", b"c" * 5000]
    (tmp_path / "x.rec").write_bytes(rec.encode_records(items))
    assert [bytes(r.record) for r in rec.read_records(spark, str(tmp_path / "x.rec")).orderBy("idx").collect()] == items
    assert rec.decode_records(b"") == []
    df = spark.createDataFrame([(i, bytes([i])) for i in range(9)], "i long, r binary")
    assert sorted(x for s in rec.pack_shards(df, "r", "i", 3).collect() for x in rec.decode_records(bytes(s.content))) == [bytes([i]) for i in range(9)]


def test_jsonl(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(json.dumps({"fen": "f", "moves": {"e2e4": 5}}) + "\nnot json\n")
    assert rec.read_moves_jsonl(spark, str(tmp_path / "m.jsonl")).collect()[0].moves == {"e2e4": 5}


def test_vocabulary_and_vectors(spark):
    assert len(tx.move_vocabulary()) == 1968
    r = spark.range(1).select(numeric.masked_softmax(F.array(F.lit(1.0), F.lit(9.0), F.lit(1.0)), F.array(F.lit(1), F.lit(0), F.lit(1))).alias("p"), tx.history_tokens(F.array(F.lit("a1b1")), {"a1b1": 5}, 32).alias("h")).first()
    assert r.p == [0.5, 0.0, 0.5] and r.h == [32] * 11 + [5]


def test_rating_stream_equals_batch(spark, tmp_path):
    from plyworks.streaming.ratings import rate_games, rate_stream

    schema = "player string, game_no long, opponent_rating double, opponent_rd double, score double"
    rows = [("a", n, 1500.0 + n, 60.0, float(n % 2)) for n in range(4)] + [("b", n, 1400.0, 60.0, 1.0) for n in range(3)]
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = rate_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("rated").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("rated").collect()) == sorted(rate_games(df).collect())
