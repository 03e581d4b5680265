"""Queries over games that follow from the keys of a table, on their way through texts, files, replays and model inputs.

A customer's game has 24 plies: twice a knight of either side goes out and back, then each pawn is pushed once, by one square or two.
Which knights, squares and pawns, and in what order, are digits of the key, so there are as many games as keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalog import BOUNDS, CLASS, _event_files, _t, query
from .functions import text as tx
from .operators import sequences as seq
from .operators.ordered import shared_folder
from .plans import evaluation as ev
from .plans import records, serving, training
from .sources import games, lz4_games, reports
from .sources import records as rec
from .sources.record_files import read_files, read_sets, session_path

_HEADERS = ["Event", "GameId", "WhiteElo", "BlackElo", "TimeControl", "Termination"]

#: c_custkey, ply, side, uci, double (a pawn's two squares) and clk of the games, by SQL.
_PLIES = """(select c_custkey, p::int as ply, case when p % 2 = 1 then 'w' else 'b' end as side, two, (300 - p - c_custkey % 60)::double as clk,
case when p > 8 and p % 2 = 1 then f || '2' || f || (3 + two) when p > 8 then f || '7' || f || (6 - two)
when p % 4 = 1 then list_value('b1a3', 'b1c3', 'g1f3', 'g1h3')[i + 1] when p % 4 = 2 then list_value('b8a6', 'b8c6', 'g8f6', 'g8h6')[i + 1]
when p % 4 = 3 then list_value('a3b1', 'c3b1', 'f3g1', 'h3g1')[i + 1] else list_value('a6b8', 'c6b8', 'f6g8', 'h6g8')[i + 1] end as uci
from (select *, case when p <= 8 then 0 else ((c_custkey * 7919) >> (j + 8 * b)) & 1 end as two, chr((97 + case when b = 0 then (j * 3 + c_custkey) & 7 else (j * 5 + (c_custkey >> 3)) & 7 end)::int) as f, (c_custkey >> (2 * (r + 2 * b))) & 3 as i
from (select c_custkey::bigint as c_custkey, p, (p - 1) % 2 as b, greatest(p - 9, 0) // 2 as j, least(p - 1, 7) // 4 as r from customer, range(1, 25) t(p))))"""

#: The games' headers, by SQL.
_GAMES = """(select c_custkey::bigint as c_custkey, case when c_custkey % 5 = 0 then 'Rated Bullet game' else 'Rated Blitz game' end as event, case when c_custkey % 11 <> 0 then 1000 + c_custkey * 37 % 1500 end::int as white_elo,
(1000 + c_custkey * 53 % 1500)::int as black_elo, list_value('1-0', '0-1', '1/2-1/2', '*')[(c_custkey % 4 + 1)::int] as result, case when c_custkey % 6 = 0 then 'Time forfeit' else 'Normal' end as termination,
case when c_custkey % 3 = 0 then -1 else 300 end::double as initial_time, case when c_custkey % 3 = 0 then -1 else c_custkey % 6 end::double as increment from customer)"""


def _moves(spark, d):
    """A row per ply in standard notation, with the columns of the games' headers."""
    names = lambda *sans: F.array(*map(F.lit, sans))
    pick = lambda array, i: F.get(array, i.cast("int"))
    c, p = F.col("game_id"), F.col("ply")
    black = F.pmod(p - 1, F.lit(2))
    j, r = F.floor(F.greatest(p - 9, F.lit(0)) / 2), F.floor((p - 1) / 4)
    i = F.expr("(game_id >> cast(2 * (floor((ply - 1) / 4) + 2 * pmod(ply - 1, 2)) as int)) & 3")
    file = F.when(black == 0, F.pmod(j * 3 + c, F.lit(8))).otherwise(F.pmod(j * 5 + F.shiftright(c, 3), F.lit(8)))
    two = F.pmod(F.floor(c * 7919 / F.pow(F.lit(2.0), j + 8 * black)), F.lit(2))
    out = F.when(black == 0, pick(names("Na3", "Nc3", "Nf3", "Nh3"), i)).otherwise(pick(names("Na6", "Nc6", "Nf6", "Nh6"), i))
    back = F.when(black == 0, pick(names("Nb1", "Nb1", "Ng1", "Ng1"), i)).otherwise(pick(names("Nb8", "Nb8", "Ng8", "Ng8"), i))
    pawn = F.concat(F.char(97 + file), F.when(black == 0, 3 + two).otherwise(6 - two).cast("string"))
    keys = _t(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("game_id")).repartition(spark.sparkContext.defaultParallelism, "game_id")
    m = keys.select("game_id", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("ply"))
    m = m.withColumn("san", F.when(p > 8, pawn).when(p - 4 * r <= 2, out).otherwise(back)).withColumn("clk", 300 - p - c % 60)
    elo = lambda by: (1000 + c * by % 1500).cast("string")
    return m.select(
        "game_id", "ply", "san", "clk", F.when(c % 5 == 0, "Rated Bullet game").otherwise("Rated Blitz game").alias("Event"), c.cast("string").alias("GameId"),
        F.when(c % 11 != 0, elo(37)).alias("WhiteElo"), elo(53).alias("BlackElo"), F.when(c % 3 == 0, "-").otherwise(F.concat(F.lit("300+"), (c % 6).cast("string"))).alias("TimeControl"),
        F.when(c % 6 == 0, "Time forfeit").otherwise("Normal").alias("Termination"), pick(names("1-0", "0-1", "1/2-1/2", "*"), c % 4).alias("result"),
    )


def _texts(spark, d):
    """game_id and pgn; the result is a header too."""
    return reports.game_text(_moves(spark, d), [*_HEADERS, "Result"])


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/games-{uuid.uuid4().hex}"


def _headed(df):
    return games.with_headers(df).withColumn("game_id", F.try_element_at("headers", F.lit("GameId")).cast("long"))


def _plies(spark, d):
    return records.plies(_headed(_texts(spark, d).select("pgn")))


_TYPED = ["game_id", "event", "white_elo", "black_elo", "result", "termination", "initial_time", "increment"]
_HEADED = f"select c_custkey as game_id, event, white_elo, black_elo, result, termination, initial_time, increment, 24 as moves from {_GAMES}"


def _typed(df):
    """Typed headers, and how many moves with a clock the text has."""
    return _headed(df).select(*_TYPED, F.size(F.regexp_extract_all("movetext", F.lit(r"\[%clk "), F.lit(0))).alias("moves"))


@query(f"select c_custkey as game_id, ply, side, uci, clk, sum(two) over (partition by c_custkey order by ply)::int as pushed from {_PLIES}")
def g10_keyed_games(spark, d):
    """Games replayed from their text: moves by squares, clocks, and from the positions how many pawns stand two squares from where they began."""
    row = lambda k, pawn: F.length(F.regexp_replace(F.get(F.split(F.split("fen_after", " ")[0], "/"), k), f"[^{pawn}]", ""))
    return _plies(spark, d).select("game_id", "ply", "side", "uci", "clk", (row(4, "P") + row(3, "p")).alias("pushed"))


@query(_HEADED)
def g11_game_files(spark, d):
    """Games written as gzipped text, and read again from folders below a folder."""
    folder = _folder(spark)
    reports.write_lines(_texts(spark, d).withColumnRenamed("pgn", "value"), f"{folder}/year/month")
    return _typed(games.read_games(spark, folder, "*.gz").select("pgn"))


@query(_HEADED)
def g12_arriving_games(spark, d):
    """The same read as a stream that takes what has arrived; a stream's rows are stored once, by its checkpoint."""
    folder = _folder(spark)
    reports.write_lines(_texts(spark, d).withColumnRenamed("pgn", "value"), f"{folder}/in", compress=False)
    found = _typed(games.stream_games(spark, f"{folder}/in").select("pgn"))
    found.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").format("parquet").start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _store_lz4(folder: str, shared_path: bool | str):
    """Stores a task's games as frames of one LZ4 file, a batch a frame; it is renamed when whole, so a lost task leaves no half file."""

    def store(parts):
        import pandas as pd
        import pyarrow as pa

        from .sources.record_files import Place

        place, name = Place(shared_path), f"{folder}/{uuid.uuid4().hex}.pgn.lz4"
        with place.create(name + ".part") as out:
            for part in parts:
                out.write(pa.compress("".join(part["pgn"]).encode(), "lz4", asbytes=True))
        place.move(name + ".part", name)
        yield pd.DataFrame({"name": [name]})

    return store


def _lz4_files(spark, d) -> str:
    """A folder of LZ4 files; which of them count is what tasks reported, so a task that ran twice leaves nothing that is read."""
    folder = _folder(spark)
    made = _texts(spark, d).repartition(4, "game_id").mapInPandas(_store_lz4(f"{folder}/made", session_path(spark)), "name string")
    reports.write_lines(made.withColumnRenamed("name", "value"), f"{folder}/names", compress=False)
    return f"{folder}/names"


def _read_lz4(spark, names: str, **options):
    files = [r["value"] for r in spark.read.text(names).collect()]  # a name a file, of four
    parts = [lz4_games.read_games(spark, f, **options) for f in files]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(_HEADED)
def g13_lz4_files(spark, d):
    """Games in LZ4 files, read by runs of frames."""
    return _typed(_read_lz4(spark, _lz4_files(spark, d), bytes_per_task=20_000).select("pgn"))


@query(f"select c_custkey as game_id, white_elo, black_elo, case when white_elo < 1200 then 'low' when white_elo >= 1400 and white_elo < 1800 then 'middle' end as white_band, case when black_elo < 1200 then 'low' when black_elo >= 1400 and black_elo < 1800 then 'middle' end as black_band from {_GAMES} where event = 'Rated Blitz game' and result <> '*' and white_elo is not null and initial_time = 300 and (white_elo < 1200 or white_elo between 1400 and 1799 or black_elo < 1200 or black_elo between 1400 and 1799)")
def g14_eval_games(spark, d):
    """Games for an evaluation set, told by their headers alone."""
    found = ev.eval_games(_headed(_texts(spark, d).select("pgn")), [(0, 1200, "low"), (1400, 1800, "middle")])
    return found.select("game_id", "white_elo", "black_elo", "white_band", "black_band")


#: id and move of the vocabulary by its rule, in SQL: queen's and knight's targets square by square, then promotions.
_VOCABULARY = """(with s as (select range::int as s from range(64)), q as (select a.s, b.s as t, abs(a.s % 8 - b.s % 8) as x, abs(a.s // 8 - b.s // 8) as y from s a, s b where a.s <> b.s),
m as (select s, t, case when x = 0 or y = 0 or x = y then 0 else 1 end as k from q where x = 0 or y = 0 or x = y or x * y = 2)
select row_number() over (order by s, k, t) - 1 as id, chr(97 + s % 8) || (s // 8 + 1) || chr(97 + t % 8) || (t // 8 + 1) as move from m)"""


@query(f"""with p as {_PLIES}, v as materialized {_VOCABULARY}, t as (select c_custkey, ply, id from p join v on uci = move)
select c_custkey as game_id, ply, repeat('1968,', greatest(11 - ply, 0)::int) || case when ply < 12 then '1968,' else '' end || string_agg(id::varchar, ',') over (partition by c_custkey order by ply rows between 11 preceding and current row) as tokens from t""")
def g15_history_tokens(spark, d):
    """Tokens of the last twelve moves after each ply, filled up in front."""
    words = tx.move_vocabulary()
    ids = _plies(spark, d).select("game_id", "ply", tx.move_id(F.col("uci"), words).alias("id"))  # once a ply, not once for each history that it is in
    p = seq.history(ids, "game_id", "ply", "id", 12, "h", with_current=True, largest=records.GAME_PLIES)
    return p.select("game_id", "ply", F.array_join(tx.filled(F.col("h"), len(words)).cast("array<string>"), ",").alias("tokens"))


_SCALES = {"white_elo": (1500.0, 400.0), "black_elo": (1600.0, 300.0), "white_clock": (5.0, 1.5), "black_clock": (5.25, 1.25), "increment": (1.0, 0.5)}


@query(f"""with p as (select p.*, g.* exclude (c_custkey), last_value(case when side = 'w' then clk end ignore nulls) over w as wc, last_value(case when side = 'b' then clk end ignore nulls) over w as bc from {_PLIES} p join {_GAMES} g using (c_custkey) window w as (partition by p.c_custkey order by ply rows between unbounded preceding and current row))
select white_elo, black_elo, wc as white_clock, coalesce(bc, initial_time) as black_clock, case result when '0-1' then 0 when '1/2-1/2' then 1 else 2 end::int as class, 90 as tokens, 90::bigint as attended, round((white_elo - 1500) / 400, 9) as f0, round((black_elo - 1600) / 300, 9) as f1,
round((ln(1 + wc) - 5) / 1.5, 9) as f2, round((ln(1 + coalesce(bc, initial_time)) - 5.25) / 1.25, 9) as f3, round((ln(1 + increment) - 1) / 0.5, 9) as f4 from p where initial_time > 0 and white_elo is not null and result <> '*' and (white_elo + black_elo) / 2 >= 1200""")
def g16_winner_samples(spark, d):
    """Model inputs of results: tokens, scaled ratings and clocks, the class."""
    made = training.winner_samples(records.winner_records(_plies(spark, d), low=1200), _SCALES)
    f = [F.round(F.get("features", i), 9).alias(f"f{i}") for i in range(5)]
    attended = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda s, x: s + x)
    return made.select("white_elo", "black_elo", "white_clock", "black_clock", F.col("winner").alias("class"), F.size("input_ids").alias("tokens"), attended.alias("attended"), *f)


@query(f"""with p as {_PLIES}, h as (select *, coalesce(string_agg(uci, ',') over (partition by c_custkey order by ply rows between unbounded preceding and 1 preceding), '') as before from p)
select c_custkey as game_id, ply, before as history, ((ply + 1) // 2)::int as fullmove, case when ply % 2 = 1 then 'w' else 'b' end as side, case c_custkey % 4 when 1 then 0 when 2 then 1 when 0 then 2 end::int as class from h where ply <= 12""")
def g17_sql_functions(spark, d):
    """Functions and the table function of moves as SQL calls them."""
    from .functions import registry

    registry.register(spark)
    view = f"games_{uuid.uuid4().hex}"
    _headed(_texts(spark, d).select("pgn")).select("game_id", "movetext", "result").createOrReplaceTempView(view)
    return spark.sql(f"""
        with p as (select g.game_id, g.result, m.* from {view} g, lateral game_plies(g.movetext) m where m.ply <= 12),
        h as (select *, coalesce(collect_list(uci) over (partition by game_id order by ply rows between unbounded preceding and 1 preceding), array()) as moves from p)
        select game_id, ply, substring_index(pipe_key(moves, fen_before), '|', -1) as history, fullmove(fen_before) as fullmove, split(strip_counters(fen_before), ' ')[1] as side, result_class(result) as class
        from h""")


@query(f"select count(*) as rows, count(*) filter (where event = 'Rated Blitz game') as blitz, count(white_elo) as rated, count(*) filter (where result = '*') as unfinished from {_GAMES}")
def g18_counted_games(spark, d):
    """Counters that fill while games are written, without a pass of their own."""
    headed, seen = records.counted(_headed(_texts(spark, d).select("pgn")), f"games-{uuid.uuid4().hex}", blitz=F.col("event") == "Rated Blitz game", rated=F.col("white_elo").isNotNull(), unfinished=F.col("result") == "*")
    headed.write.parquet(f"{_folder(spark)}/kept")
    names = ["rows", "blitz", "rated", "unfinished"]
    return spark.createDataFrame([tuple(seen.get[n] for n in names)], ", ".join(f"{n} long" for n in names))


_EVENT_JSON = "'{\"event_id\":' || event_id || ',\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}'"


@query(f"select global_idx, hex({_EVENT_JSON}) as record from (select *, row_number() over (order by event_id) - 1 as global_idx from events) where global_idx >= 100 and global_idx < 600")
def q91_record_dump(spark, d):
    """Records by their index over eight files, found by the files' offsets."""
    return rec.dump_records(read_files(spark, _event_files(spark, d)), 100, 500, as_hex=True)


@query("select dataset, row_number() over (order by dataset, event_id) - 1 as global_idx, event_id from (select 0 as dataset, event_id from events union all select 1, event_id from events union all select 2, event_id from events) order by 1, 2")
def q92_record_sets(spark, d):
    """Three sets of record files under one index."""
    sets = [(_event_files(spark, d), "inside"), (_event_files(spark, d, plain=True, limits="separate"), "separate"), (_event_files(spark, d), "inside")]
    return rec.parsed_records(read_sets(spark, sets).select("dataset", "global_idx", "record"), "event_id long")


@query("""select 'line' as kind, user_id::varchar as fen, event_type as move, count(*) as n from events group by 2, 3
union all select 'no JSON of this kind', null, null, count(*) from events where event_id % 1000 = 7 having count(*) > 0 union all select 'no moves', null, null, count(*) from events where event_id % 1000 = 8 having count(*) > 0""")
def q93_move_lines(spark, d):
    """Common moves as gzipped JSON lines and back, with broken lines among them, which are counted by what is wrong."""
    e = _t(spark, d, "events")
    per = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("user_id").cast("string").alias("fen")).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("moves"))
    broken = e.filter("event_id % 1000 in (7, 8)").select(F.when(F.col("event_id") % 1000 == 7, F.concat(F.lit('{"fen": "'), F.col("event_type"))).otherwise(F.format_string('{"fen":"%d"}', "event_id")).alias("value"))
    path = f"{_folder(spark)}/common"
    reports.write_lines(reports.json_lines(per).unionByName(broken), path)
    good = rec.read_moves_jsonl(spark, path).select(F.lit("line").alias("kind"), "fen", F.explode("moves").alias("move", "n"))
    none = F.lit(None).cast("string")
    return good.unionByName(rec.moves_errors(spark, path).select(F.col("reason").alias("kind"), none.alias("fen"), none.alias("move"), F.col("lines").alias("n")))


@query(f"""with e as (select value, (event_id % 7)::int as b from events where value is not null), c as (select value, b, {CLASS.format("value")} as own, list_value(0.5, 3, 12.5, 40, 105, 225, 400)[b + 1] as centre from e)
select round(avg(abs(centre - value)), 9) as mae, avg((own = b)::int)::double as accuracy from c""")
def q94_clock_errors(spark, d):
    e = _t(spark, d, "events").filter("value is not null").select("value", (F.col("event_id") % 7).cast("int").alias("b"))
    return ev.clock_errors(e, "b", "value", BOUNDS, 400.0).select(F.round("mae", 9).alias("mae"), "accuracy")


@query("""with m as (select user_id, case event_id % 3 when 0 then 'model' when 1 then 'common_moves' else 'fallback' end as source, (event_id % 101) / 100.0::double as t, (event_id % 53) / 100.0::double as c, event_id % 6 + 1 as r from events)
select user_id, count(*) as moves, count(*) filter (where source = 'model') as model_moves, count(*) filter (where source = 'common_moves') as common_moves, count(*) filter (where source = 'fallback') as fallback_moves, round(avg(t) filter (where source = 'model'), 9) as top_prob,
round(avg(c) filter (where source = 'model'), 9) as chosen_prob, round(avg(r) filter (where source = 'model'), 9) as chosen_rank, round(100 * avg((r <= 1)::int) filter (where source = 'model'), 9) as top1_percent, round(100 * avg((r <= 3)::int) filter (where source = 'model'), 9) as top3_percent from m group by 1""")
def q95_move_quality(spark, d):
    at = lambda n: F.col("event_id") % n
    m = _t(spark, d, "events").select("user_id", F.when(at(3) == 0, "model").when(at(3) == 1, "common_moves").otherwise("fallback").alias("source"), (at(101) / 100.0).alias("top_move_prob"), (at(53) / 100.0).alias("chosen_move_prob"), (at(6) + 1).alias("chosen_move_rank"))
    found = ev.move_quality(m, "user_id")
    return found.select(*[F.round(c, 9).alias(c) if c.endswith(("prob", "rank", "percent")) else c for c in found.columns])


_SHARES = "(select user_id, {0} as half, event_type, count(*) / sum(count(*)) over (partition by user_id, {0}) as p from events group by 1, 2, 3)"


def _shares(events, *keys):
    n = events.groupBy(*keys, "event_type").agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy(*keys).agg(F.sum("n").alias("all"), F.collect_list(F.struct("event_type", "n")).alias("e"))
    return per.select(*keys, F.map_from_entries(F.transform("e", lambda x: F.struct(x["event_type"], x["n"] / F.col("all")))).alias("probs"))


@query(f"""with s as (select user_id, event_type, p from {_SHARES.format("0")}), o as (select event_id, e.user_id, e.event_type, s.p from events e join s using (user_id, event_type))
select event_id, (case when event_id % 10 = 3 then null else (select count(*) from s where s.user_id = o.user_id and s.p > o.p) + 1 end)::int as rank from o""")
def q96_played_ranks(spark, d):
    """The rank of the type that came, among the user's types by how frequent they are; of a type that has no share, none."""
    played = F.when(F.col("event_id") % 10 == 3, "none").otherwise(F.col("event_type"))
    joined = _t(spark, d, "events").join(_shares(_t(spark, d, "events"), "user_id"), "user_id")
    return joined.select("event_id", ev.played_rank(F.col("probs"), played).alias("rank"))


@query(f"""with s as {_SHARES.format("event_id % 2")}, a as (select * from s where half = 0), b as (select * from s where half = 1)
select user_id, round(sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))), 9) as gap from a full join b using (user_id, event_type) where user_id in (select user_id from a) and user_id in (select user_id from b) group by 1""")
def q97_distribution_gaps(spark, d):
    """Two models' distributions of the same positions, and how far they lie apart."""
    s = _shares(_t(spark, d, "events").withColumn("half", F.col("event_id") % 2), "user_id", "half")
    return ev.distribution_gaps(s.filter("half = 0"), s.filter("half = 1"), "user_id").select("user_id", F.round("gap", 9).alias("gap"))


@query("""with m as (select o_orderkey, floor((o_custkey + 400 + o_custkey * 7 % 900) / 2) as r, (o_orderkey % 7) / 10.0::double as w, 0.3::double as dr, 0.7 - (o_orderkey % 7) / 10.0::double as b from orders),
x as (select *, case when r < 400 then 400 - r when r >= 600 then r - 600 + 1 else 0 end as d1, case when r < 800 then 800 - r when r >= 1000 then r - 1000 + 1 else 0 end as d2 from m)
select o_orderkey, case when d1 <= d2 then '400_600' else '800_1000' end as model, least(d1, d2)::double as distance, round(w - b + 0.5 * dr, 9) as evaluation, case when w - b + 0.5 * dr > 0.1 then 'White is better' when w - b + 0.5 * dr < -0.1 then 'Black is better' else 'Position is equal' end as assessment from x""")
def q98_evaluated_positions(spark, d):
    """Requests with the band of the mean rating, the evaluation and what it says."""
    c, w = F.col("o_custkey"), (F.col("o_orderkey") % 7) / 10.0
    asked = _t(spark, d, "orders").select("o_orderkey", c.alias("white_rating"), (400 + c * 7 % 900).alias("black_rating"), w.alias("white"), F.lit(0.3).cast("double").alias("draw"), (F.lit(0.7).cast("double") - w).alias("black"))
    bands = serving.registry_bands(["400_600", "800_1000", "readme"])
    return serving.evaluated_positions(asked, bands).select("o_orderkey", "model", "distance", F.round("evaluation", 9).alias("evaluation"), "assessment")


def _mark(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || user_id), 1, 13))::bigint / 4503599627370496.0"


@query(f"""with c as (select user_id, event_type as move, count(*) as n from events group by 1, 2), t as (select *, n::double / sum(n) over (partition by user_id) as p from c),
common as (select user_id, arg_min(move, upto) as move from (select *, sum(n) over (partition by user_id order by move) as upto, sum(n) over (partition by user_id) as total from c where user_id % 3 = 0) where upto > {_mark(41)} * total group by 1),
kept as (select *, round(p * 1e9)::bigint as w from t where user_id % 3 = 1 and (p >= 0.26 or not exists (select 1 from t u where u.user_id = t.user_id and u.p >= 0.26))),
model as (select user_id, arg_min(move, upto) as move from (select *, sum(w) over (partition by user_id order by move) as upto, sum(w) over (partition by user_id) as total from kept) where upto > {_mark(42)} * total group by 1), u as (select user_id, min(event_type) as legal from events group by 1)
select user_id, case when user_id % 13 = 0 then 'game over' when user_id % 3 = 0 then 'common_moves' when user_id % 3 = 1 then 'model' else 'fallback' end as source, case when user_id % 13 <> 0 then coalesce(common.move, model.move, legal) end as move from u left join common using (user_id) left join model using (user_id)""")
def q99_chosen_moves(spark, d):
    """The answer per request: drawn from common moves, else from the model's likely ones, else the first legal one."""
    n = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counts"), F.array_sort(F.collect_list("event_type")).alias("legal"))
    of = lambda k, c: F.when(F.col("user_id") % 3 == k, F.col(c))
    asked = per.join(_shares(_t(spark, d, "events"), "user_id"), "user_id").withColumn("moves", of(0, "counts")).withColumn("probs", of(1, "probs"))
    asked = asked.withColumn("legal", F.when(F.col("user_id") % 13 == 0, F.array().cast("array<string>")).otherwise(F.col("legal"))).withColumn("min_probability", F.lit(0.26))
    return serving.chosen_moves(asked, "user_id", 41).select("user_id", "source", "move")
