"""Evaluation, serving, reports, record shards and ratings on small tables whose answers are worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from plyworks.functions import registry
from plyworks.functions import text as tx
from plyworks.operators import aggregates as agg
from plyworks.operators import filters
from plyworks.plans import evaluation as ev
from plyworks.plans import records, serving, training
from plyworks.sources import games as src
from plyworks.sources import records as rec
from plyworks.sources import reports
from plyworks.streaming import ratings

BANDS = [(1000, 1600, "low"), (1600, 2000, "high")]
HEAD = '[Event "{}"]\n[Result "{}"]\n[WhiteElo "1750"]\n[BlackElo "1500"]\n[TimeControl "{}"]\n\n'
MOVES = "1. e4 { [%clk 0:02:58] } e5 { [%clk 0:02:57] } 2. Nf3 { [%clk 0:02:55] } Nc6 { [%clk 0:02:50] }"


def test_eval_set(spark, tmp_path):
    texts = [HEAD.format("Rated Blitz game", "1-0", "180+2") + MOVES + " 1-0\n", HEAD.format("Rated Blitz game", "*", "180+2") + MOVES + " *\n",
             HEAD.format("Rated Blitz game", "1-0", "1/40") + MOVES + " 1-0\n", HEAD.format("Casual game", "1-0", "180+2") + MOVES + " 1-0\n"]
    (tmp_path / "g.pgn").write_text("\n".join(texts))
    games = ev.eval_games(src.with_headers(src.read_games(spark, str(tmp_path))), BANDS).withColumn("game_id", F.lit(1).cast("long"))
    got = ev.eval_records(records.plies(games), BANDS, skip_plies=1, min_plies=4).orderBy("ply").collect()
    assert [(r.ply, r.played_move, r.elo_band, r.white_clock, r.black_clock, r.result_for_side, len(r.move_history)) for r in got] == [
        (2, "e7e5", "low", 178.0, 180.0, 0.0, 1), (3, "g1f3", "high", 178.0, 177.0, 1.0, 2), (4, "b8c6", "low", 175.0, 177.0, 0.0, 3)]
    assert ev.eval_records(records.plies(games), BANDS, min_plies=5).count() == 0
    balanced = ev.balanced_set(ev.eval_records(records.plies(games), BANDS, skip_plies=0, min_plies=4), 1)
    assert sorted((r.elo_band, r.ply) for r in balanced.collect()) == [("high", 1), ("low", 2)]


def predictions(spark):
    rows = [(1, {"a": 0.5, "b": 0.3, "c": 0.2}, "a", 0.9, 1.0), (2, {"a": 0.5, "b": 0.3, "c": 0.2}, "c", 0.4, 0.5), (3, {"a": 1.0}, "z", 0.2, 0.0)]
    return spark.createDataFrame(rows, "id long, probs map<string,double>, played_move string, p double, result_for_side double")


def test_metrics(spark):
    df = predictions(spark)
    m = ev.move_metrics(df).first()
    assert (m.n, m.top1, m.top3) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3))
    o = ev.outcome_metrics(df).first()
    assert o.brier == pytest.approx((0.01 + 0.01 + 0.04) / 3)
    assert o.log_loss == pytest.approx(-(math.log(0.9) + 0.5 * math.log(0.4) + 0.5 * math.log(0.6) + math.log(0.8)) / 3)
    other = df.filter("id < 3").withColumn("probs", F.create_map(F.lit("a"), F.lit(0.6), F.lit("d"), F.lit(0.4)))
    gaps = ev.distribution_gaps(df, other, "id")
    assert [round(r.gap, 9) for r in gaps.collect()] == [1.0, 1.0]
    s = ev.gap_summary(gaps).first()
    assert (s.n, round(s.maximum, 9), round(s.mean, 9)) == (2, 1.0, 1.0)
    assert ev.both_scored(df, other, "id").count() == 2


def test_losses_and_classes(spark):
    df = spark.createDataFrame([(k, float(k), k % 3 - 1, (k % 2) - 1) for k in range(6)], "step long, loss double, y int, p int")
    assert [(r.window, r.loss, r.steps) for r in ev.loss_windows(df, "step", "loss", 4).orderBy("window").collect()] == [(0, 1.5, 4), (1, 4.5, 2)]
    got = ev.rolling_mean(df.withColumn("run", F.lit(1)), "run", "step", "loss", 3, "m").orderBy("step").collect()
    assert [r.m for r in got] == [0.0, 0.5, 1.0, 2.0, 3.0, 4.0]
    acc = ev.class_accuracy(df, "y", "p", [-1, 0, 1]).first()
    want = [(k % 3 - 1, k % 2 - 1) for k in range(6)]
    assert acc.accuracy == pytest.approx(sum(a == b for a, b in want) / 6) and acc.class_1 == pytest.approx(sum((a == 1) == (b == 1) for a, b in want) / 6)
    b = spark.range(1).select(ev.masked_brier(F.array(F.lit(1.0), F.lit(9.0), F.lit(1.0)), F.array(F.lit(1), F.lit(0), F.lit(1)), F.lit(0)).alias("b")).first().b
    assert b == pytest.approx(0.5)
    clock = spark.createDataFrame([(0, 0.4), (2, 9.0), (1, 9.0)], "b int, t double")
    e = ev.clock_errors(clock, "b", "t", [0.0, 1.0, 5.0, float("inf")], 8.0).first()
    assert (e.mae, e.accuracy) == (pytest.approx((0.1 + 1 + 6) / 3), pytest.approx(2 / 3))


def test_match_and_move_quality(spark):
    games = spark.createDataFrame([(1.0, 10, "mate"), (0.5, 30, "stalemate"), (0.0, 20, "mate"), (1.0, 20, "time")], "score double, n_moves int, termination string")
    m = ev.match_summary(games).first()
    assert (m.games, m.wins, m.draws, m.losses, m.score, m.mean_length, m.min_length, m.max_length) == (4, 2, 1, 1, 2.5, 20.0, 10, 30)
    assert {r.termination: r.percent for r in ev.ending_shares(games).collect()} == {"mate": 50.0, "stalemate": 25.0, "time": 25.0}
    moves = spark.createDataFrame([("model", 0.6, 0.6, 1), ("model", 0.8, 0.1, 4), ("common_moves", None, None, None)], "source string, top_move_prob double, chosen_move_prob double, chosen_move_rank int")
    q = ev.move_quality(moves).first()
    assert (q.moves, q.model_moves, q.common_moves, q.fallback_moves, q.chosen_rank, q.top1_percent, q.top3_percent) == (3, 2, 1, 0, 2.5, 50.0, 50.0)
    assert ev.partition_sizes(spark.range(10).repartition(2)).first().filled == 2


def test_weighted_median_and_bounds(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 5), (9.0, 1)], "v double, c long")
    assert agg.weighted_median(df, "v", "c").first()["median"] == 2.0
    times = spark.createDataFrame([(float(k % 40),) for k in range(4000)], "t double")
    bounds = agg.linear_then_equal_bounds(times, "t", 12, 5.0, 1.0)
    assert bounds[:6] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and bounds[-1] == float("inf") and len(bounds) <= 13 and bounds == sorted(set(bounds))
    # a tail that goes on in steps of the width makes the even part longer
    dense = spark.createDataFrame([(float(k % 9),) for k in range(900)], "t double")
    assert agg.linear_then_equal_bounds(dense, "t", 9, 5.0, 1.0)[:8] == [float(k) for k in range(8)]


def ratings_after_edits(spark):
    held = spark.createDataFrame([("u", 1500.0, 100.0), ("v", 1400.0, 60.0)], "user_id string, rating double, rd double")
    edits = spark.createDataFrame([("u", 1600.0, 1), ("u", 1700.0, 2), ("v", 99.0, 3), ("w", 900.0, 1)], "user_id string, new_rating double, edited_at long")
    return {r.user_id: (r.rating, r.rd) for r in serving.edited_ratings(held, edits).collect()}


def test_requests_and_counters(spark):
    rows = [(1500, "white", "win"), (99, "white", "win"), (1500, "green", "win"), (1500, None, "win"), (1500, "black", "lost"), (None, "x", "y")]
    df = spark.createDataFrame(rows, "bot_rating int, player_color string, result string")
    got = [r.r for r in df.select(filters.request_reason("bot_rating", "player_color", "result").alias("r")).collect()]
    assert got == [None, "bot_rating: out of range", "player_color: not allowed", "player_color: missing", "result: not allowed", "bot_rating: missing"]
    seen_rows, seen = records.counted(df, "requests", white=F.col("player_color") == "white")
    assert seen_rows.count() == 6 and seen.get == {"rows": 6, "white": 2}


def test_game_endings(spark):
    dance = "1. Nf3 Nf6 2. Ng1 Ng8 " * 4
    rows = [(1, dance), (2, "1. f3 e5 2. g4 Qh4#"), (3, "1. e4 e5")]
    p = records.plies(spark.createDataFrame(rows, "game_id long, movetext string"))
    assert {r.game_id: (r.plies, r.ending) for r in records.game_endings(p).collect()} == {1: (16, "repetition"), 2: (4, "mate"), 3: (2, None)}


def test_training_samples(spark):
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    clocks = spark.createDataFrame([(start, ["e2e4"], 1600, 9.0, 99.0, 2.0, 3.0)], "fen string, recent_moves array<string>, rating int, player_clock double, opponent_clock double, increment double, thinking_time double")
    logs = {f: (0.0, 1.0) for f in ("player_clock", "opponent_clock", "increment", "white_clock", "black_clock", "time")}
    scales = logs | {"rating": (1500.0, 100.0), "white_elo": (1500.0, 100.0), "black_elo": (1500.0, 100.0)}
    r = training.clock_samples(clocks, scales, [0.0, 1.0, 5.0, 20.0, 60.0, float("inf")]).first()
    assert len(r.input_ids) == 12 + 78 == sum(r.attention_mask) and len(r.legal_ids) == 20 and r.input_ids[10] == len(tx.move_vocabulary())
    assert (r.rating, r.bucket_mask, r.target_bucket) == (1.0, [1, 1, 1, 0, 0], 1) and r.clock_features == pytest.approx([math.log(10), math.log(100), math.log(3)])
    won = clocks.select("fen", "recent_moves", F.lit(-1).alias("winner"), F.lit(1600).alias("white_elo"), F.lit(1400).alias("black_elo"), F.lit(9.0).alias("white_clock"), F.lit(99.0).alias("black_clock"), "increment")
    w = training.winner_samples(won, scales).first()
    assert (w.winner, w.winner_raw) == (0, -1) and w.features == pytest.approx([1.0, -1.0, math.log(10), math.log(100), math.log(3)])
    counts = {"e2e4": {"60.0": {"1500": 6, "1700": 2}}, "d2d4": {"30.0": {"1500": 2}}}
    many = spark.range(2000).select("id", F.lit(start).alias("fen"), F.array().cast("array<string>").alias("recent_moves"))
    many = many.crossJoin(spark.createDataFrame([(counts,)], "moves map<string,map<string,map<string,bigint>>>"))
    got = serving.draw_pair(many, "id", 3).groupBy("move", "clock", "rating").count().collect()
    share = {(x.move, x.clock, x.rating): x["count"] / 2000 for x in got}
    assert set(share) == {("e2e4", 60.0, 1500), ("e2e4", 60.0, 1700), ("d2d4", 30.0, 1500)} and abs(share["e2e4", 60.0, 1500] - 0.6) < 0.04
    m = training.move_samples(many.limit(3), "id", scales, 3).orderBy("id").first()
    assert m.move_id == tx.move_vocabulary()[m.move] and m.log_time == pytest.approx(math.log(61 if m.move == "e2e4" else 31))


def test_bucket_files_and_drawn_seconds(spark, tmp_path):
    good = {"boundaries": [0, 1, 5, None], "n_buckets": 3, "scheme": "s", "time_control": "180+2", "statistics": {"total_samples": 5}, "bucket_probabilities": [0.2, 0.3, 0.5], "bucket_widths": [1, 4, None],
            "bucket_empirical_distributions": [{"type": "seconds", "distribution": {"0": 1.0}}, {"type": "seconds", "distribution": {"1": 25.0, "2": 75.0}}, {"type": "frequent_values", "distribution": {"7.5": 3.0}}]}
    edits = [{}, {"n_buckets": 4}, {"boundaries": [0, 1, 1, None]}, {"bucket_empirical_distributions": good["bucket_empirical_distributions"][:2]}]
    edits += [{"bucket_empirical_distributions": [*good["bucket_empirical_distributions"][:2], x]} for x in ({"distribution": {"1": 1.0}}, {"type": "odd", "distribution": {"1": 1.0}}, {"type": "seconds", "distribution": {}}, {"type": "seconds"})]
    reasons = []
    for n, e in enumerate(edits):
        (tmp_path / f"{n}.json").write_text(json.dumps(good | e))
        reasons.append(rec.read_buckets(spark, str(tmp_path / f"{n}.json")).first().reason)
    assert reasons[0] is None and all(reasons[1:]) and len(set(reasons[1:])) == 6
    r = rec.read_buckets(spark, str(tmp_path / "0.json"))
    assert r.first().boundaries[-1] == math.inf
    per = r.select(F.posexplode("bucket_empirical_distributions").alias("bucket", "d")).select("bucket", "d.distribution")
    got = serving.draw_seconds(spark.range(3000).withColumn("b", (F.col("id") % 4).cast("int")), "id", "b", per, 2).groupBy("b", "seconds").count().collect()
    n = {(x.b, x.seconds): x["count"] for x in got}
    assert set(n) == {(0, 0.0), (1, 1.0), (1, 2.0), (2, 7.5), (3, None)} and abs(n[1, 2.0] / 750 - 0.75) < 0.06


def test_csv_report(spark, tmp_path):
    schema = "fen string, history array<string>, low int, high int, gap double, low_top array<struct<move:string,p:double>>, high_top array<struct<move:string,p:double>>, in_low boolean, in_high boolean"
    df = spark.createDataFrame([("f w", ["e2e4", "e7e5"], 1100, 1500, 0.25, [("a", 0.5), ("b", 0.25)], [], True, None)], schema)
    reports.write_csv(reports.gap_report(df).coalesce(1), str(tmp_path / "r"))
    lines = [x for f in (tmp_path / "r").glob("*.csv") for x in f.read_text().splitlines()]
    assert lines == ["fen,recent_moves,rating_pair,total_variation_distance,top5_lower_rating,top5_higher_rating,in_lower_common_moves,in_higher_common_moves", 'f w,"e2e4,e7e5",1100-1500,0.250000,a:0.5000; b:0.2500,"",True,False']


def test_serving(spark):
    fen = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    ask = spark.createDataFrame([(1, fen, []), (2, fen, None), (3, "x y z - 0 1", ["e2e4"])], "id long, fen string, history array<string>")
    table = lambda rows: spark.createDataFrame(rows, "key string, moves map<string,bigint>")
    got = {r.id: (r.strategy, r.moves) for r in serving.lookup_moves(ask, table([(f'[[],"{fen}"]', {"e2e4": 3})]), table([(fen[:-4], {"d2d4": 2})]), table([]), table([("x y z - 0 1", {"g1f3": 1})])).collect()}
    assert got == {1: ("history", {"e2e4": 3}), 2: ("position", {"d2d4": 2}), 3: ("direct", {"g1f3": 1})}
    many = spark.range(4000).withColumn("moves", F.create_map(F.lit("a"), F.lit(3).cast("long"), F.lit("b"), F.lit(1).cast("long")))
    share = serving.draw_move(many, "id", 5).groupBy("move").count().collect()
    assert abs({r.move: r["count"] for r in share}["a"] / 4000 - 0.75) < 0.03
    schema = "id long, moves map<string,bigint>, probs map<string,double>, legal array<string>, min_probability double"
    rows = [(1, {"e2e4": 2}, {"a2a3": 1.0}, ["e2e4"], 0.0), (2, None, {"a2a3": 0.9, "b2b3": 0.1}, ["a2a3"], 0.5), (3, None, None, ["h2h3", "h2h4"], 0.0), (4, {"e2e4": 2}, None, [], 0.0)]
    got = {r.id: (r.source, r.move) for r in serving.chosen_moves(spark.createDataFrame(rows, schema), "id", 3).collect()}
    assert got == {1: ("common_moves", "e2e4"), 2: ("model", "a2a3"), 3: ("fallback", "h2h3"), 4: ("game over", None)}
    assert serving.registry_bands(["1400_1600", "1000_1200", "notes"]) == [(1000, 1200, "1000_1200"), (1400, 1600, "1400_1600")]
    ev_rows = spark.createDataFrame([(1300, 1501, 0.6, 0.2, 0.2)], "white_rating int, black_rating int, white double, draw double, black double")
    r = serving.evaluated_positions(ev_rows, serving.registry_bands(["1000_1200", "1400_1600"])).first()
    assert (r.model, r.distance, r.evaluation, r.assessment) == ("1400_1600", 0.0, pytest.approx(0.5), "White is better")
    hist = spark.createDataFrame([("u", n, n * 10) for n in range(5)] + [("v", 9, 90)], "user_id string, game_no long, played_at long")
    assert ratings_after_edits(spark) == {"u": (1700.0, 150.0), "v": (1400.0, 60.0), "w": (900.0, 350.0)}
    page, total = serving.history_page(hist, "u", 1, 2)
    assert [r.game_no for r in page.collect()] == [3, 2] and total.first().total_count == 5


def test_reports(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string")
    assert [r.value for r in reports.markdown_lines(df).collect()] == ["| n | t |", "|---|---|", "| 1 | a\\|b |", "| 2 |  |"]
    assert [r.value for r in reports.json_lines(df.limit(1)).collect()] == ['{"n":1,"t":"a|b"}']
    moves = spark.createDataFrame([(1, 2, "e5", None, "1-0", "Club"), (1, 1, "e4", 178.0, "1-0", "Club")], "game_id long, ply int, san string, clk double, result string, Event string")
    assert reports.game_text(moves, ["Event"]).first().pgn == '[Event "Club"]\n\n1. e4 {[%clk 0:02:58]} e5 1-0\n'
    clocks = spark.createDataFrame([("k1 w - - 0 1", ["a"], 1500, 9.0, 8.0, 2.0, 1.0), ("k1 w - - 5 9", ["b"], 1400, 7.0, 8.0, 2.0, 0.5)], "fen string, recent_moves array<string>, rating int, player_clock double, opponent_clock double, increment double, thinking_time double")
    r = reports.grouped_clock_records(clocks, with_history=False).first()
    assert (r.fen, r.thinking_times, r.ratings, r["count"]) == ("k1 w - -", [0.5, 1.0], [1400, 1500], 2)
    assert reports.grouped_clock_records(clocks, with_history=True).count() == 2


def test_lines_round_trip(spark, tmp_path):
    moves = spark.createDataFrame([("f", {"e2e4": 5})], "fen string, moves map<string,bigint>")
    reports.write_lines(reports.json_lines(moves), str(tmp_path / "x"))
    assert rec.read_moves_jsonl(spark, str(tmp_path / "x")).collect() == moves.collect()


@pytest.mark.parametrize("ending", [".bagz", ".bag"])
def test_record_ranges(spark, tmp_path, ending):
    df = spark.createDataFrame([(i, f"record {i}".encode() if i % 3 else b"") for i in range(40)], "i long, r binary")
    path = f"{tmp_path}/set@2{ending}"
    rec.write_records(df, "r", "i", path, 2)
    want = sorted((r.source_file.rsplit("/")[-1], r.idx, bytes(r.record)) for r in rec.read_records(spark, path).collect())
    for n in (1, 7, 1000):
        assert sorted((r.source_file.rsplit("/")[-1], r.idx, bytes(r.record)) for r in rec.read_record_ranges(spark, path, rows_per_task=n).collect()) == want
    assert [(r.idx, bytes(r.record)) for r in rec.read_record_ranges(spark, path, rows_per_task=5, wanted=(7, 8)).orderBy("source_file").collect()] == [x[1:] for x in want if x[1] == 7]


@pytest.mark.parametrize("ending", [".bagz", ".bag"])
def test_record_shards(spark, tmp_path, ending):
    df = spark.createDataFrame([(i, f"record {i}".encode() if i else b"") for i in range(20)], "i long, r binary")
    path = f"{tmp_path}/set@3{ending}"
    names = rec.write_records(df, "r", "i", path, 3)
    assert names == [f"{tmp_path}/set-0000{k}-of-00003{ending}" for k in range(3)]
    got = rec.with_global_index(rec.read_records(spark, path))
    assert sorted(bytes(r.record) for r in got.collect()) == sorted(bytes(r.r) for r in df.collect())
    assert sorted(r.global_idx for r in got.collect()) == list(range(20))
    assert rec.record_at(got, 7).count() == 1 and rec.empty_records(got).count() == 1
    assert rec.dump_records(got, 5, 3, as_hex=True).count() == 3
    both = rec.concat_records(rec.read_records(spark, path), rec.read_records(spark, path))
    assert sorted(r.global_idx for r in both.collect()) == list(range(40))
    assert both.filter("dataset = 1").agg(F.min("global_idx")).first()[0] == 20


def test_separate_limits_and_json(spark, tmp_path):
    df = rec.json_records(spark.createDataFrame([(1, "x")], "n int, t string"))
    whole = rec.encode_records([bytes(r.record) for r in df.collect()])
    (tmp_path / "a.bagz").write_bytes(whole[:-8])
    (tmp_path / "limits.a.bagz").write_bytes(whole[-8:])
    got = rec.parsed_records(rec.read_records(spark, str(tmp_path / "a.bagz"), separate_limits=True), "n int, t string").first()
    assert (got.n, got.t, got.idx) == (1, "x", 0)


def test_sql_functions(spark):
    registry.register(spark)
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    r = spark.sql(f"select size(legal_moves('{start}')) as n, size(legal_move_ids('{start}')) as m, game_outcome('{start}') as o, san_to_uci(array('e4', 'e5')) as u, san_to_uci(array('e4', 'e4')) as bad, fen_tokens('{start}') as t").first()
    assert (r.n, r.m, r.o, r.u, r.bad, len(r.t)) == (20, 20, None, ["e2e4", "e7e5"], None, 78)
    from plyworks.functions import text as tx

    assert spark.range(1).select(tx.fen_tokens(F.lit(start)).alias("t")).first().t == r.t
    x = spark.sql(f"select strip_counters('{start}') as s, fullmove('{start}') as f, fullmove('x') as g, pipe_key(array('a', 'b'), 'p') as k, result_class('0-1') as c, history_tokens(array('e2e4', 'e7e5')) as h").first()
    ids = tx.move_vocabulary()
    assert (x.s, x.f, x.g, x.k, x.c, list(x.h)) == (start[:-4], 1, None, "p|a,b", 0, [1968] * 10 + [ids["e2e4"], ids["e7e5"]])
    assert spark.sql("select move from moves_vocabulary where id = 0").first().move == "a1b1" and spark.sql(f"select count(*) n from values ('{start}') t(fen) where fullmove(fen) >= 1").first().n == 1
    assert [x.uci for x in spark.sql("select uci from game_plies('1. d4 d5 2. Qd4') order by ply").collect()] == ["d2d4", "d7d5"]


def test_user_ratings_and_stream(spark, tmp_path):
    schema = "user_id string, game_no long, played_at long, opponent_rating double, opponent_rd double, score double"
    df = spark.createDataFrame([("u", 1, 0, 1500.0, 50.0, 1.0), ("u", 2, 86400 * 10, 1600.0, 50.0, 0.0), ("v", 1, 0, 1500.0, 50.0, 0.5)], schema)
    got = {(r.user_id, r.game_no): r for r in ratings.user_history(df).collect()}
    more = df.unionByName(spark.range(50).select(F.lit("w").alias("user_id"), (100 - F.col("id")).alias("game_no"), F.col("id").alias("played_at"), F.lit(1500.0).alias("opponent_rating"), F.lit(50.0).alias("opponent_rd"), F.lit(1.0).alias("score")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a user's games come in several batches
    try:
        long = [r.games_played for r in ratings.user_history(more).filter("user_id = 'w'").orderBy("game_no").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert long == list(range(1, 51))
    assert got["v", 1].rating == 1500.0 and got["u", 1].rating > 1500 > got["v", 1].rd
    first = got["u", 1]
    assert got["u", 2].rd_before == round(math.sqrt(first.rd**2 + 34.64 * 10), 1) and got["u", 2].games_played == 2 and got["u", 2].losses == 1
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ratings.user_history_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("users").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("users").collect())) == sorted(map(tuple, got.values()))


def test_match_ratings_use_what_was_before(spark):
    df = spark.createDataFrame([("m", 1, "a", "b", 1.0), ("m", 2, "b", "a", 1.0)], "match_id string, game_no long, white string, black string, score double")
    one, two = ratings.rate_matches(df).orderBy("game_no").collect()
    assert one.white_rating - 1500 == pytest.approx(1500 - one.black_rating) and one.white_rd == pytest.approx(one.black_rd)
    assert two.white_rating > one.black_rating and two.black_rating < one.white_rating


def test_result_may_be_a_header_of_game_text(spark):
    from plyworks.sources import games, reports

    moves = spark.createDataFrame([(1, 1, "e4", 60.0, "1-0"), (1, 2, "e5", None, "1-0"), (2, 1, "d4", 5.0, None)], "game_id int, ply int, san string, clk double, result string")
    text = {r.game_id: r.pgn for r in reports.game_text(moves.withColumn("Event", F.lit('a "b"')), ["Event", "Result"]).collect()}
    assert text[1] == '[Event "a \\"b\\""]\n[Result "1-0"]\n\n1. e4 {[%clk 0:01:00]} e5 1-0\n'
    assert text[2].endswith('[Result "?"]\n\n1. d4 {[%clk 0:00:05]} *\n')
    plain = spark.createDataFrame([(text[1].replace('a \\"b\\"', "a"),)], "pgn string")
    assert games.with_headers(plain).first().result == "1-0"


def test_seeded_buckets_hold_all_rows_in_seeded_order(spark, data):
    from plyworks.operators import sequences as seq

    events = spark.read.parquet(f"{data}/events.parquet").select("event_id")
    bucketed = lambda parts: seq.seeded_buckets(events.repartition(parts), 8, 5, "event_id").select(F.spark_partition_id().alias("part"), "event_id", seq.seeded_place(5, "event_id").alias("h")).collect()
    rows = bucketed(3)
    per = {}
    for r in rows:
        per.setdefault(r.part, []).append((r.h, r.event_id))
    assert sorted(r.event_id for r in rows) == sorted(r.event_id for r in events.collect()) and len(per) == 8
    assert all(p == sorted(p) for p in per.values())
    assert rows == bucketed(7)


def test_move_ids_are_those_of_the_vocabulary(spark):
    from plyworks.functions import text as tx

    words = tx.move_vocabulary()
    df = spark.createDataFrame([(m,) for m in [*words, "a1a1", "e", "", "e7e8", None]], "m string")
    got = {r.m: r.i for r in df.select("m", tx.move_id(F.col("m"), words).alias("i")).collect()}
    assert got == {**words, "a1a1": None, "e": None, "": None, "e7e8": words["e7e8"], None: None}


def test_partition_sizes(spark):
    from plyworks.plans import evaluation as ev

    df = spark.range(10, numPartitions=1).union(spark.range(3, numPartitions=1)).union(spark.range(0, numPartitions=1))
    assert ev.partition_sizes(df).first().asDict() == {"maximum": 10, "minimum": 3, "filled": 2}
