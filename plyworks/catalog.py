"""Queries over the shared test tables, each with the SQL that must give the same rows.

events stand in for plies (user: game, event_type: move, value: clock), orders for rated games, embeddings for model
outputs, labels for targets.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog_ratings import rating_fold
from .functions import numeric as num
from .functions import text as tx
from .operators import aggregates as agg
from .operators import filters, joins
from .operators import sequences as seq
from .operators.ordered import Scan, scan
from .plans import evaluation as ev
from .plans import serving

QUERIES: dict = {}
SQL: dict[str, str] = {}
BANDS = [(0, 50000, "low"), (50000, 150000, "middle"), (150000, 300000, "high")]
GAPPED = [(10000, 20000, "a"), (40000, 60000, "b"), (100000, 150000, "c")]
BOUNDS = [0.0, 1.0, 5.0, 20.0, 60.0, 150.0, 300.0, float("inf")]
CLASS = "case when {0} < 1 then 0 when {0} < 5 then 1 when {0} < 20 then 2 when {0} < 60 then 3 when {0} < 150 then 4 when {0} < 300 then 5 else 6 end"
#: A number in [0, 1) from a user's key, as `seeded_unit(11, ...)` gives it.
_UNIT = "('0x' || substr(md5('11:' || user_id), 1, 13))::bigint / 4503599627370496.0"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_totalprice between 50000 and 150000 and o_custkey between 100 and 900")
def q01_band_filter(spark, d):
    o = filters.both_in_band(_t(spark, d, "orders"), "o_totalprice", "o_totalprice", 50000, 150000)
    return filters.both_in_band(o, "o_custkey", "o_custkey", 100, 900).select("o_orderkey", "o_custkey", "o_totalprice")


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'O') and (o_custkey + o_orderkey) // 2 between 100 and 5000")
def q02_status_filter(spark, d):
    o = filters.one_of(_t(spark, d, "orders"), "o_orderstatus", ["F", "O"])
    return filters.average_in_band(o, "o_custkey", "o_orderkey", 100, 5000).select("o_orderkey", "o_orderstatus")


@query("select reason, count(*) as n from (select case when value is null then 'value: missing' when value not between 5 and 400 then 'value: out of range' when user_id not between 2 and 1000000 then 'user_id: out of range' end as reason from events) group by reason")
def q03_range_validation(spark, d):
    return _t(spark, d, "events").select(filters.range_reason({"value": (5, 400), "user_id": (2, 1000000)}).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, event_id, value from (select *, max(value) over (partition by user_id) as m from events) where value >= 480 or m < 480")
def q04_min_prob_fallback(spark, d):
    return filters.likely_or_all(_t(spark, d, "events"), "user_id", "value", 480).select("user_id", "event_id", "value")


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select o_custkey from orders group by o_custkey having count(*) > 10)")
def q05_anti_join_common(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey").withColumn("one", F.lit(1))
    return joins.without_common(o, agg.common_keys(o, "o_custkey", "one", 10), "o_custkey").select("o_orderkey", "o_custkey")


@query("select c_custkey, c_custkey in (select o_custkey from orders where o_totalprice > 200000) as big from customer")
def q06_semi_flag(spark, d):
    big = _t(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.flag_common(_t(spark, d, "customer").select("c_custkey"), big, "c_custkey", "big")


@query("""with a as (select l_partkey as key, count(*) as v from lineitem where l_quantity > 45 group by 1), b as (select l_partkey as key, count(*) as v from lineitem where l_quantity > 30 group by 1), c as (select p_partkey as key, cast(p_size as bigint) as v from part where p_size > 10)
select p_partkey, coalesce(a.v, b.v, c.v) as found, case when a.v is not null then 'exact' when b.v is not null then 'position' when c.v is not null then 'direct' else 'not found' end as strategy
from part left join a on a.key = p_partkey left join b on b.key = p_partkey left join c on c.key = p_partkey""")
def q07_lookup_cascade(spark, d):
    line, part = _t(spark, d, "lineitem"), _t(spark, d, "part")
    counts = lambda q: agg.count_by(line.filter(F.col("l_quantity") > q).select(F.col("l_partkey").alias("key")), "key", out="v")
    sizes = part.filter("p_size > 10").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("v"))
    steps = [("exact", counts(45), "p_partkey", "v"), ("position", counts(30), "p_partkey", "v"), ("direct", sizes, "p_partkey", "v")]
    return joins.cascade(part.select("p_partkey"), steps, "found", "strategy")


@query("select o_orderkey, b.name as band from orders left join (values (0, 50000, 'low'), (50000, 150000, 'middle'), (150000, 300000, 'high')) b(lo, hi, name) on o_totalprice >= lo and o_totalprice < hi")
def q08_range_join_band(spark, d):
    return joins.in_band(_t(spark, d, "orders"), "o_totalprice", BANDS, "band").select("o_orderkey", "band")


@query("""with b(lo, hi, name) as (values (10000, 20000, 'a'), (40000, 60000, 'b'), (100000, 150000, 'c')), x as (select o_orderkey, name, lo, case when o_totalprice < lo then lo - o_totalprice when o_totalprice >= hi then o_totalprice - hi + 1 else 0 end as dist from orders, b)
select o_orderkey, name as band, dist as distance from (select *, row_number() over (partition by o_orderkey order by dist, lo) as r from x) where r = 1""")
def q09_nearest_band(spark, d):
    return joins.nearest_band(_t(spark, d, "orders"), "o_totalprice", GAPPED, "band", "distance").select("o_orderkey", "band", "distance")


@query("""with a as (select l_orderkey as key, max(l_quantity) as v from lineitem where l_orderkey % 3 <> 0 group by 1), b as (select l_orderkey as key, max(case when l_linenumber > 1 then l_quantity else 1 end) as v from lineitem where l_orderkey % 5 <> 0 group by 1)
select coalesce(a.key, b.key) as key, a.v as "left", b.v as "right", case when a.key is null then 'only right' when b.key is null then 'only left' else 'differs' end as state from a full join b on a.key = b.key where a.key is null or b.key is null or a.v is distinct from b.v""")
def q10_full_outer_diff(spark, d):
    line = _t(spark, d, "lineitem")
    a = line.filter("l_orderkey % 3 <> 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_quantity").alias("v"))
    b = line.filter("l_orderkey % 5 <> 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.max(F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).otherwise(1)).alias("v"))
    return joins.key_difference(a, b, "k", "v")


@query(f"select user_id, event_type, cast({CLASS.format('value')} as integer) as bucket, count(*) as cnt from events group by 1, 2, 3")
def q11_histogram_flat(spark, d):
    return agg.count_by(_t(spark, d, "events").withColumn("bucket", agg.bucket_of(F.col("value"), BOUNDS)), "user_id", "event_type", "bucket")


@query("select user_id, event_type, count(*) as cnt from events where user_id in (select user_id from events group by 1 having count(*) <= 70) group by 1, 2")
def q12_having_max(spark, d):
    return agg.within_total(agg.count_by(_t(spark, d, "events"), "user_id", "event_type"), "user_id", "cnt", 70)


@query("""with t as (select user_id, event_type, count(*) as total from events group by 1, 2), b as (select user_id, min(case when total > 15 then event_type end) as bad from t group by 1)
select t.* from t join b using (user_id) where total <= 15 and (bad is null or event_type < bad)""")
def q13_having_sequential(spark, d):
    return agg.within_total_sequential(agg.count_by(_t(spark, d, "events"), "user_id", "event_type", out="total"), "user_id", "event_type", "total", 15)


@query("select event_type, sum(cnt)::bigint as cnt from (select user_id, event_type, count(*) as cnt from events group by 1, 2) group by 1")
def q14_rollup_move(spark, d):
    return agg.count_by(agg.count_by(_t(spark, d, "events"), "user_id", "event_type"), "event_type", count="cnt")


@query("""with c as (select user_id from events group by 1 having count(*) > 66) select e.user_id, event_type, count(*) as cnt, t.total from events e join (select user_id, count(*) as total from events group by 1 having count(*) > 66) t using (user_id) group by 1, 2, 4""")
def q15_common_threshold(spark, d):
    flat = agg.count_by(_t(spark, d, "events"), "user_id", "event_type")
    return flat.join(agg.common_keys(flat, "user_id", "cnt", 66), "user_id").select("user_id", "event_type", "cnt", "total")


@query("select user_id, string_agg(event_type, ',' order by event_id) as types, count(*) as n from events where user_id in (select user_id from events group by 1 having count(*) <= 60) group by 1")
def q16_collect_group(spark, d):
    rare, _ = agg.route_common(_t(spark, d, "events"), "user_id", 60)
    items = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    return rare.groupBy("user_id").agg(F.array_join(F.transform(items, lambda x: x["event_type"]), ",").alias("types"), F.count(F.lit(1)).alias("n"))


@query("select user_id, arg_max(event_type, event_id) as event_type from events group by 1")
def q17_last_wins(spark, d):
    return agg.last_write(_t(spark, d, "events"), "user_id", "event_type", "event_id")


@query("select l_returnflag, sum(l_quantity) as n, sum(l_discount * l_quantity) / sum(l_quantity) as mean, sqrt(greatest(sum(l_discount * l_discount * l_quantity) / sum(l_quantity) - (sum(l_discount * l_quantity) / sum(l_quantity)) ** 2, 0)) as std from lineitem group by 1")
def q18_weighted_stats(spark, d):
    return agg.weighted_statistics(_t(spark, d, "lineitem"), "l_discount", "l_quantity", "l_returnflag")


@query("""select 'value' as field, count(value) as count, avg(ln(1 + value)) as mean, stddev_pop(ln(1 + value)) as std, min(value) as min, max(value) as max, quantile_cont(value, 0.5) as median from events
union all select 'user_id', count(user_id), avg(user_id), stddev_pop(user_id), min(user_id)::double, max(user_id)::double, quantile_cont(user_id::double, 0.5) from events""")
def q19_log_scalers(spark, d):
    return agg.field_statistics(_t(spark, d, "events"), ["value", "user_id"], ("value",))


@query("select quality, count(*) as n, count(*) / (select count(*) from labels) as share from labels group by 1")
def q20_label_dist(spark, d):
    return agg.shares(_t(spark, d, "labels"), "quality")


@query(f"select cast({CLASS.format('value')} as integer) as bucket, count(*) as n, count(*) / sum(count(*)) over () as p from events group by 1")
def q21_bucket_probs(spark, d):
    bounds = F.array(*map(F.lit, BOUNDS))
    return agg.shares(_t(spark, d, "events").select(num.bucket_index(F.col("value"), bounds).alias("bucket")), "bucket", "p")


@query("select event_type, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95, quantile_cont(value, 0.99) as p99, avg(value) as mean, case when quantile_cont(value / 20, 0.95) < 5 then 'bullet' when quantile_cont(value / 20, 0.95) < 20 then 'blitz' when quantile_cont(value / 20, 0.95) < 60 then 'rapid' else 'classical' end as speed from events group by 1")
def q22_percentile_class(spark, d):
    return agg.clock_percentiles(_t(spark, d, "events"), "value", "event_type")


@query(f"select cast({CLASS.format('value')} as integer) as bucket, round_even(value, 0) as second, count(*) as n, 100.0 * count(*) / sum(count(*)) over (partition by cast({CLASS.format('value')} as integer)) as percent from events group by 1, 2")
def q23_bucket_seconds(spark, d):
    return agg.second_shares(_t(spark, d, "events").withColumn("bucket", agg.bucket_of(F.col("value"), BOUNDS)), "bucket", "value")


@query("""with n as (select p_size % 5 as bucket, round_even(p_size * 0.25::double, 1)::double as tenth, count(*) as n from part group by 1, 2), p as (select *, 100.0 * n / sum(n) over (partition by bucket) as percent, row_number() over (partition by bucket order by n desc, tenth) as rank from n),
q as (select *, coalesce(sum(percent) over (partition by bucket order by rank rows between unbounded preceding and 1 preceding), 0) as b from p) select bucket, tenth, n, percent, rank::integer as rank from q where rank <= 4 and b <= 95""")
def q24_bucket_topvalues(spark, d):
    part = _t(spark, d, "part").select((F.col("p_size") % 5).alias("bucket"), (F.col("p_size") * 0.25).cast("double").alias("value"))
    return agg.leading_values(part, "bucket", "value", most=4)


@query("select count(distinct user_id) as keys, (select count(*) from (select user_id from events group by 1 having count(*) > 1)) as repeated from events")
def q25_distinct_dupes(spark, d):
    return agg.key_repeats(_t(spark, d, "events"), "user_id")


@query("select avg((r <= 1)::int) as top1, avg((r <= 3)::int) as top3, avg((r <= 5)::int) as top5 from (select event_type, rank() over (partition by user_id order by value desc) as r from events) where event_type = 'purchase'")
def q26_topk_accuracy(spark, d):
    ranked = _t(spark, d, "events").withColumn("r", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("value"))))
    return agg.tops_at(ranked.filter("event_type = 'purchase'"), "r", 1, 3, 5)


_PREDICTED = "select doc_id, toxic as y, 1 / (1 + exp(-((doc_id % 97) / 97.0 * 4 - 2))) as p from labels"


def _predicted(spark, d):
    return _t(spark, d, "labels").select("doc_id", F.col("toxic").alias("y"), (1 / (1 + F.exp(-((F.col("doc_id") % 97) / 97.0 * 4 - 2)))).alias("p"))


@query(f"select avg((p - y) ** 2) as brier, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) as log_loss from ({_PREDICTED})")
def q27_brier_logloss(spark, d):
    p, y = F.col("p"), F.col("y")
    return _predicted(spark, d).agg(F.avg((p - y) * (p - y)).alias("brier"), F.avg(agg.log_loss(p, y)).alias("log_loss"))


@query(f"""with s as (select p, y, (rank() over (order by p) + rank() over (order by p) + count(*) over (partition by p) - 1) / 2.0 as r from ({_PREDICTED}))
select (sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) as auc from s""")
def q28_auc(spark, d):
    return agg.auc(_predicted(spark, d), "p", "y")


@query(f"select bin::integer as bin, count(*) as n, avg(p) as predicted, avg(y) as observed from (select *, ntile(10) over (order by p, doc_id) as bin from ({_PREDICTED})) group by 1")
def q29_calibration(spark, d):
    return agg.calibration(_predicted(spark, d), "p", "y", ["doc_id"])


@query("select quality, toxic, count(*) as n from labels group by 1, 2")
def q30_confusion(spark, d):
    return agg.confusion(_t(spark, d, "labels"), "quality", "toxic")


@query("""with x as (select vec_id, label % 3 as y, unnest(embedding[1:3])::double as z, generate_subscripts(embedding[1:3], 1) - 1 as i from embeddings), e as (select *, exp(z - max(z) over (partition by vec_id)) as e from x), p as (select *, e / sum(e) over (partition by vec_id) as p from e)
select vec_id, sum((p - (i = y)::int) ** 2) as brier from p group by 1""")
def q31_multiclass_brier(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", num.brier(num.softmax(F.slice("embedding", 1, 3)), F.col("label") % 3).alias("brier"))


@query("select phase, count(*) as n from (select case when (r - 1) < 0.2 * c then 'early' when (r - 1) >= 0.8 * c then 'late' else 'middle' end as phase from (select event_type, row_number() over (partition by user_id order by event_id) as r, count(*) over (partition by user_id) as c from events) where event_type = 'purchase') group by 1")
def q32_phase_wins(spark, d):
    w = Window.partitionBy("user_id")
    e = _t(spark, d, "events").withColumn("r", F.row_number().over(w.orderBy("event_id")) - 1).withColumn("c", F.count(F.lit(1)).over(w)).filter("event_type = 'purchase'")
    return agg.count_by(e.withColumn("phase", agg.phase(F.col("r"), F.col("c"))), "phase", out="n")


@query("with p as (select event_type, count(*) / sum(count(*)) over () as p from events group by 1) select event_type, (1 / (p + 1e-6)) / avg(1 / (p + 1e-6)) over () as weight from p")
def q33_class_weights(spark, d):
    return agg.class_weights(_t(spark, d, "events"), "event_type")


@query("select o_custkey, count(*) as games, count(*) filter (where o_orderstatus = 'F') as wins, count(*) filter (where o_orderstatus = 'O') as losses, 100.0 * count(*) filter (where o_orderstatus = 'F') / count(*) as win_percent from orders group by 1")
def q34_user_totals(spark, d):
    return agg.result_totals(_t(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O")


@query("select event_id, string_agg(event_type, ',') over (partition by user_id order by event_id rows between 11 preceding and current row) as h from events")
def q35_history_window_incl(spark, d):
    return seq.history(_t(spark, d, "events"), "user_id", "event_id", "event_type", 12, "h", with_current=True).select("event_id", F.array_join("h", ",").alias("h"))


@query("select event_id, coalesce(string_agg(event_type, ',') over (partition by user_id order by event_id rows between 12 preceding and 1 preceding), '') as h from events")
def q36_history_window_excl(spark, d):
    return seq.history(_t(spark, d, "events"), "user_id", "event_id", "event_type", 12, "h", with_current=False).select("event_id", F.array_join("h", ",").alias("h"))


@query("""with s as (select *, case when event_id % 2 = 0 then 'w' else 'b' end as side from events)
select event_id, coalesce(case when side = 'w' then last_value(case when side = 'b' then value end ignore nulls) over w else last_value(case when side = 'w' then value end ignore nulls) over w end, 300) as other from s window w as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding)""")
def q37_opponent_asof(spark, d):
    e = _t(spark, d, "events").withColumn("side", F.when(F.col("event_id") % 2 == 0, "w").otherwise("b"))
    return joins.last_known_of_other(e, "user_id", "event_id", "side", "value", 300.0, "other").select("event_id", "other")


@query("select event_id, greatest(coalesce(lag(value) over (partition by user_id, event_type order by event_id), 300) + 2 - value, 0) as think from events")
def q38_think_time(spark, d):
    return seq.thinking_time(_t(spark, d, "events"), ["user_id", "event_type"], "event_id", "value", F.lit(2.0), F.lit(300.0), "think").select("event_id", "think")


@query("with j as (select user_id, event_id, value, coalesce(value - lag(value) over (partition by user_id order by event_id) >= 2 * 238, false) as bad from events) select user_id, event_id from j where user_id not in (select user_id from j where bad)")
def q39_drop_invalid_group(spark, d):
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    e = _t(spark, d, "events").withColumn("bad", seq.clock_jump(F.col("value"), before, F.lit(238.0)))
    return seq.drop_groups_with(e, "user_id", F.col("bad")).select("user_id", "event_id")


@query("select event_type, event_id from (select *, row_number() over (partition by event_type order by ts, event_id) as r from events) where r <= 25")
def q40_stratified_cap(spark, d):
    return seq.first_of_each(_t(spark, d, "events"), "event_type", ["ts", "event_id"], 25).select("event_type", "event_id")


@query("select event_id, sum(value) over w as total, max(value) over w as maximum from events window w as (partition by user_id order by event_id rows between unbounded preceding and current row)")
def q41_cumulative(spark, d):
    return seq.running(_t(spark, d, "events"), "user_id", ["event_id"], "value", "total", "maximum").select("event_id", "total", "maximum")


@query("select user_id, avg(value) filter (where u <= 10) as first_mean, avg(value) filter (where v <= 10) as last_mean from (select *, row_number() over (partition by user_id order by event_id) as u, row_number() over (partition by user_id order by event_id desc) as v from events) group by 1")
def q42_first_last_n(spark, d):
    return seq.ends_mean(_t(spark, d, "events"), "user_id", ["event_id"], "value", 10)


@query("""with p as (select a.vec_id, unnest(a.embedding)::double as x, unnest(b.embedding)::double as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
select vec_id, round(sum(abs(x - y)), 6) as l1, round(sum(abs(x - y)) / 2, 6) as tvd from p group by 1 order by 2 desc, 1 limit 50""")
def q43_topk_score(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    scored = pairs.select("vec_id", F.round(num.l1_distance(F.col("embedding"), F.col("other")), 6).alias("l1"), F.round(num.total_variation(F.col("embedding"), F.col("other")), 6).alias("tvd"))
    return seq.top_k(scored, 50, "l1", "vec_id")


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 20 offset 40")
def q44_page(spark, d):
    return seq.page(_t(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 40, 20)


@query("select s_suppkey, cast((row_number() over (order by s_suppkey) - 1) % 4 as integer) as shard from supplier")
def q45_round_robin(spark, d):
    return seq.round_robin(_t(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], 4)


@query("""with x as (select event_id, event_id % 7 as f, cast(floor(value) as bigint) as v from events where value is not null)
select event_id, case f when 2 then v + 0.5 when 5 then -1.0 when 6 then v + 3600.0 else v end::double as seconds, case f when 1 then v when 6 then v + 3600 else 0 end::double as strict from x""")
def q46_clock_parse(spark, d):
    v, k = F.floor("value"), F.col("event_id") % 7
    m, s = F.floor(v / 60), v % 60
    forms = ["%d:%02d", "0:%02d:%02d", "%d:%02d.5"]
    clock = F.when(k == 3, F.format_string("%d.0", v)).when(k == 4, v.cast("string")).when(k == 5, F.format_string("x%d", v)).otherwise(F.format_string(" 1:%02d:%02d ", m, s))
    for n, form in enumerate(forms):
        clock = F.when(k == n, F.format_string(form, m, s)).otherwise(clock)
    e = _t(spark, d, "events").filter("value is not null")
    return e.select("event_id", tx.clock_seconds(clock).alias("seconds"), tx.strict_clock_seconds(clock).alias("strict"))


@query("""select o_orderkey, case o_orderkey % 3 when 2 then concat('["e2e4","p', o_custkey, ' w - -') else concat('p', o_custkey, ' w KQ e3') end as stripped, case o_orderkey % 3 when 0 then o_orderkey % 90 end::int as fullmove,
case o_orderkey % 3 when 0 then concat('p', o_custkey, ' w KQ e3 5 ', o_orderkey % 90) when 1 then concat('p', o_custkey, ' w KQ e3 0 x') else concat('p', o_custkey, ' w - - 0 7') end as position from orders""")
def q47_fen_strip(spark, d):
    k, piece = F.col("o_orderkey") % 3, F.concat(F.lit("p"), F.col("o_custkey").cast("string"))
    plain = F.concat(piece, F.lit(" w KQ e3 5 "), (F.col("o_orderkey") % 90).cast("string"))
    key = F.when(k == 0, plain).when(k == 1, F.concat(piece, F.lit(" w KQ e3 0 x"))).otherwise(tx.position_key(F.array(F.lit("e2e4")), F.concat(piece, F.lit(" w - - 0 7"))))
    return _t(spark, d, "orders").select("o_orderkey", tx.strip_counters(key).alias("stripped"), tx.fullmove(key).alias("fullmove"), tx.position_of_key(key).alias("position"))


@query("""with r as (select p_partkey, p_size, string_agg(list_value('8', '7k', '3p4', 'rnbqkbnr', 'PP6', '1Q5r', '4N2b', 'pppppppp')[((p_partkey // (3 ** i)::bigint) % 8 + 1)::int], '' order by i) as board from part, range(8) t(i) group by all),
f as (select *, replace(replace(replace(replace(replace(replace(board, '8', '........'), '7', '.......'), '6', '......'), '5', '.....'), '4', '....'), '3', '...') as b from r),
x as (select p_partkey, case when p_partkey % 2 = 0 then 'w' else 'b' end || replace(replace(b, '2', '..'), '1', '.') || rpad(list_value('', 'K', 'kq', 'KQkq')[(p_size % 4 + 1)::int], 4, '.') || rpad(case when p_size % 3 = 0 then 'e3' else '' end, 2, '.') || rpad((p_partkey % 50)::varchar, 3, '.') || rpad((p_partkey % 300 + 1)::varchar, 3, '.') as t from f)
select p_partkey, string_agg((instr('0123456789abcdefghpnrkqPBNRQKw.', substr(t, i, 1)) - 1)::varchar, ',' order by i) || ',31' as tokens from x, range(1, 78) c(i) group by 1""")
def q48_fen_tokens(spark, d):
    ranks, key, size = F.array(*map(F.lit, ("8", "7k", "3p4", "rnbqkbnr", "PP6", "1Q5r", "4N2b", "pppppppp"))), F.col("p_partkey"), F.col("p_size")
    board = F.concat_ws("/", *[F.element_at(ranks, (F.floor(key / 3**i) % 8 + 1).cast("int")) for i in range(8)])
    castling = F.element_at(F.array(*map(F.lit, ("-", "K", "kq", "KQkq"))), (size % 4 + 1).cast("int"))
    fen = F.concat_ws(" ", board, F.when(key % 2 == 0, "w").otherwise("b"), castling, F.when(size % 3 == 0, "e3").otherwise("-"), (key % 50).cast("string"), (key % 300 + 1).cast("string"))
    return _t(spark, d, "part").select("p_partkey", F.array_join(tx.fen_tokens(fen), ",").alias("tokens"))


@query("select event_type, sum(cast(json_extract(props, '$.k') as bigint))::bigint as k from events group by 1")
def q49_json_hist(spark, d):
    return agg.json_total(_t(spark, d, "events"), "event_type", "props", "k")


@query("select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 0 else -1 end as label, case o_orderstatus when 'F' then 1.0::double when 'O' then 0.5 else 0.0 end as white, case o_orderstatus when 'F' then 0.0::double when 'O' then 0.5 else 1.0 end as black from orders")
def q50_result_label(spark, d):
    result = F.when(F.col("o_orderstatus") == "F", "1-0").when(F.col("o_orderstatus") == "O", "1/2-1/2").otherwise("0-1")
    return _t(spark, d, "orders").select("o_orderkey", tx.result_label(result).alias("label"), tx.result_for_side(result, F.lit("w")).alias("white"), tx.result_for_side(result, F.lit("b")).alias("black"))


@query("""with x as (select o_orderkey, 800 + o_custkey % 1800 as r, 40 + o_orderkey % 300 as rd, 1500.0 as o, 50.0 as ord, (o_orderkey % 3) / 2.0 as s, ln(10) / 400 as q from orders), g as (select *, 1 / sqrt(1 + 3 * q * q * ord * ord / (pi() * pi())) as g from x), e as (select *, 1 / (1 + pow(10, -g * (r - o) / 400)) as e from g), p as (select *, 1.0 / (rd * rd) + q * q * g * g * e * (1 - e) as p from e)
select o_orderkey, round(least(greatest(r + q / p * g * (s - e), 100), 3500), 1) as rating, round(least(greatest(sqrt(1 / p), 30), 350), 1) as rd, case when r < 800 then 'Beginner' when r < 1000 then 'Novice' when r < 1200 then 'Intermediate' when r < 1400 then 'Club Player' when r < 1600 then 'Tournament Player' when r < 1800 then 'Expert' when r < 2000 then 'Candidate Master' when r < 2200 then 'Master' when r < 2400 then 'International Master' else 'Grandmaster' end as tier from p""")
def q51_glicko1(spark, d):
    r, rd = 800 + F.col("o_custkey") % 1800, 40 + F.col("o_orderkey") % 300
    new, new_rd = num.single_game_update(r.cast("double"), rd.cast("double"), F.lit(1500.0), F.lit(50.0), (F.col("o_orderkey") % 3) / 2.0)
    return _t(spark, d, "orders").select("o_orderkey", new.alias("rating"), new_rd.alias("rd"), num.rating_tier(r).alias("tier"))


@query("select o_orderkey, 1 / (1 + pow(10, -(o_totalprice / 1000 - 150) / 400)) as expected from orders")
def q52_elo_expected(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", num.elo_expected(F.col("o_totalprice") / 1000 - 150).alias("expected"))


@query("""with a as (select distinct l_partkey as k from lineitem where l_quantity > 48), b as (select distinct l_partkey as k from lineitem where l_discount > 0.08)
select 'only a' as part, count(*) as n from (select k from a except select k from b) union all select 'only b', count(*) from (select k from b except select k from a) union all select 'both', count(*) from (select k from a intersect select k from b) union all select 'all', count(*) from (select k from a union all select k from b)""")
def q53_set_ops(spark, d):
    line = _t(spark, d, "lineitem")
    a, b = (line.filter(c).select(F.col("l_partkey").alias("k")).distinct() for c in ("l_quantity > 48", "l_discount > 0.08"))
    return joins.set_sizes(a, b, "k")


@query("select conv_id, turn, text from conversations where turn < 2")
def q54_bag_index_slice(spark, d):
    return filters.first_rows(_t(spark, d, "conversations"), "turn", 2).select("conv_id", "turn", "text")


@query("select event_type, epoch(time_bucket(interval 1 day, ts))::bigint as day, count(*) as n from events group by 1, 2")
def x01_tumbling_days(spark, d):
    return seq.tumbling(_t(spark, d, "events"), "ts", "1 day", "event_type", out="day")


@query("select l_returnflag, quantile_cont(d, 0.5) as median from (select l_returnflag, l_discount::double as d, unnest(range(l_linenumber::bigint)) from lineitem) group by 1")
def q55_weighted_median(spark, d):
    return agg.weighted_median(_t(spark, d, "lineitem"), "l_discount", "l_linenumber", "l_returnflag")


@query("select event_type, max(value) as maximum, min(value) as minimum, avg(value) as mean, count(value) as n from events group by 1")
def q56_gap_summary(spark, d):
    return ev.gap_summary(_t(spark, d, "events"), "event_type", gap="value")


@query("select event_id // 1000 as window, avg(value) as loss, count(*) as steps from events group by 1")
def q57_loss_windows(spark, d):
    return ev.loss_windows(_t(spark, d, "events"), "event_id", "value", 1000)


@query("select event_id, avg(round(value * 100)::bigint) over (partition by user_id order by event_id rows between 99 preceding and current row) as mean from events")
def q58_rolling_mean(spark, d):
    cents = _t(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))  # whole numbers: sums don't depend on their order
    return ev.rolling_mean(cents, "user_id", "event_id", "cents", 100, "mean").select("event_id", "mean")


@query("select event_id, value from (select *, max(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as m from events) where m is null or value > m")
def q59_new_maxima(spark, d):
    return seq.new_maxima(_t(spark, d, "events"), "user_id", ["event_id"], "value").select("event_id", "value")


@query("""select o_orderpriority, count(*) as games, count(*) filter (where s = 1) as wins, count(*) filter (where s = 0.5) as draws, count(*) filter (where s = 0) as losses, sum(s) as score, 100 * avg(s) as score_percent, avg(n) as mean_length, stddev_pop(n) as std_length, min(n) as min_length, max(n) as max_length
from (select o_orderpriority, (o_orderkey % 3) / 2.0 as s, o_custkey % 80 as n from orders) group by 1""")
def q60_match_summary(spark, d):
    o = _t(spark, d, "orders").select("o_orderpriority", ((F.col("o_orderkey") % 3) / 2.0).alias("score"), (F.col("o_custkey") % 80).alias("n_moves"))
    return ev.match_summary(o, "o_orderpriority")


@query("select avg((case when y = p then 1.0 else 0.0 end)) as accuracy, avg(case when (y = 0) = (p = 0) then 1.0 else 0.0 end) as class_0, avg(case when (y = 1) = (p = 1) then 1.0 else 0.0 end) as class_1 from (select quality as y, toxic as p from labels)")
def q61_class_accuracy(spark, d):
    return ev.class_accuracy(_t(spark, d, "labels"), "quality", "toxic", [0, 1])


@query("""with x as (select vec_id, label % 3 as y, i, z::double as z, (i <> (label + 1) % 3)::int as m from (select vec_id, label, unnest(embedding[1:3]) as z, generate_subscripts(embedding[1:3], 1) - 1 as i from embeddings)), e as (select *, case when m = 1 then exp(z) else 0 end as e from x), p as (select *, e / sum(e) over (partition by vec_id) as p from e)
select vec_id, sum((p - (i = y)::int) ** 2) as brier from p group by 1""")
def q62_masked_brier(spark, d):
    blocked = (F.col("label") + 1) % 3
    mask = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (i != blocked).cast("int"))
    return _t(spark, d, "embeddings").select("vec_id", ev.masked_brier(F.slice("embedding", 1, 3), mask, F.col("label") % 3).alias("brier"))


@query("select event_type, count(*) as n, avg((p - y) ** 2) as brier, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) as log_loss from (select event_type, 0.1 + 0.8 * (user_id % 10) / 10.0 as p, (event_id % 3) / 2.0 as y from events) group by 1")
def q63_band_metrics(spark, d):
    e = _t(spark, d, "events").select("event_type", (0.1 + 0.8 * (F.col("user_id") % 10) / 10.0).alias("p"), ((F.col("event_id") % 3) / 2.0).alias("result_for_side"))
    return ev.outcome_metrics(e, "event_type")


@query("select o_orderkey, o_custkey from orders o where exists (select 1 from orders x where x.o_custkey = o.o_custkey and x.o_totalprice > 250000)")
def q64_both_scored(spark, d):
    o = _t(spark, d, "orders")
    return ev.both_scored(o.select("o_orderkey", "o_custkey"), o.filter("o_totalprice > 250000"), "o_custkey")


@query("""select user_id, event_type as move, floor(value / 50)::int::varchar as clock, (1500 + user_id % 5 * 100)::varchar as rating, count(*) as cnt from events where value is not null group by 1, 2, 3, 4""")
def q65_nested_round_trip(spark, d):
    clock, rating = F.floor(F.col("value") / 50).cast("int").cast("string"), (1500 + F.col("user_id") % 5 * 100).cast("string")
    e = _t(spark, d, "events").filter("value is not null").select("user_id", "event_type", clock.alias("clock"), rating.alias("rating"))
    nested = agg.nested_histogram(agg.count_by(e, "user_id", "event_type", "clock", "rating"), "user_id", "event_type", "clock", "rating", "cnt")
    return agg.parse_histogram(nested.select("user_id", F.to_json("moves").alias("json")), "user_id", "json")


@query("""with x as (select event_id, value, floor(value * 40)::bigint as s from events)
select event_id, format('{:d}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) as clock, case when s >= 3600 then format('{:d}h {:d}m {:d}s', s // 3600, s % 3600 // 60, s % 60) when s >= 60 then format('{:d}m {:d}s', s // 60, s % 60) else format('{:d}s', s) end as took, case when value < 10 then 'critical' when value < 30 then 'low' when value < 60 then 'caution' else 'none' end as warning, value > 100 + s % 7 as forfeit from x""")
def q66_time_texts(spark, d):
    s, forfeit = F.col("value") * 40, num.would_forfeit(F.col("value"), F.lit(100), F.floor(F.col("value") * 40) % 7)
    return _t(spark, d, "events").select("event_id", tx.hms(s).alias("clock"), tx.duration(s).alias("took"), tx.time_warning(F.col("value")).alias("warning"), forfeit.alias("forfeit"))


@query("""with x as (select *, o_orderkey % 10 as k from orders)
select o_orderkey, case when k < 8 then (60 * (1 + k))::double else -1 end as base, case when k >= 8 then -1.0::double when k < 6 then (k % 3)::double else 0 end as gain, k < 6 as increments, case when k % 2 = 0 then concat('0:0', k, ':1', k) end as clock, (1000 + k * 100)::int as low, (1100 + k * 100)::int as high, (1050 + k * 100)::double as middle, concat('p', k) as position, 'e' || (8 - k % 8)::varchar as mirrored, strftime(o_orderdate, '%Y-%m') as month from x""")
def q67_header_texts(spark, d):
    k = F.col("o_orderkey") % 10
    control = F.when(k < 6, F.concat(60 * (1 + k), F.lit("+"), k % 3)).when(k < 8, (60 * (1 + k)).cast("string")).otherwise("-")
    base, gain = tx.time_control(control)
    comment = F.when(k % 2 == 0, F.concat(F.lit("{ [%clk 0:0"), k, F.lit(":1"), k, F.lit("] }"))).otherwise("{ good }")
    low, high, middle = tx.band_bounds(F.concat(1000 + k * 100, F.lit("_"), 1100 + k * 100))
    key = tx.pipe_key(F.array(F.lit("e2e4"), F.lit("e7e5")), F.concat(F.lit("p"), k))
    month = tx.year_month(F.concat(F.lit("games_"), F.date_format("o_orderdate", "yyyy-MM"), F.lit(".txt.zst")))
    return _t(spark, d, "orders").select(
        "o_orderkey", base.alias("base"), gain.alias("gain"), tx.is_increment_control(control).alias("increments"), tx.comment_clock(comment).alias("clock"), low.alias("low"), high.alias("high"),
        middle.alias("middle"), tx.position_of_pipe_key(key).alias("position"), tx.mirror_move(F.concat(F.lit("e"), 1 + k % 8)).alias("mirrored"), month.alias("month"),
    )


@query("""with x as (select o_orderkey, 800.0::double + o_custkey % 1800 as r, 40.0::double + o_orderkey % 300 as rd, floor((epoch(timestamp '2030-01-01') - epoch(o_orderdate)) / 86400)::bigint as days, ln(10) / 400 as q, o_orderstatus from orders)
select o_orderkey, days, round(least(350, sqrt(rd * rd + 34.64 * days)), 9) as grown, least(350, rd + 50) as edited, rd > 110 as provisional, r - 1.96 * rd as low, r + 1.96 * rd as high, round(1 / sqrt(1 + 3 * q * q * rd * rd / (pi() * pi())), 9) as factor, case o_orderstatus when 'F' then 1.0::double when 'O' then 0.0 else 0.5 end as score from x""")
def q68_rating_states(spark, d):
    r, rd = 800.0 + F.col("o_custkey") % 1800, 40.0 + F.col("o_orderkey") % 300
    days = num.idle_days(F.col("o_orderdate"), F.lit("2030-01-01").cast("timestamp"))
    word = F.when(F.col("o_orderstatus") == "F", "win").when(F.col("o_orderstatus") == "O", "loss").otherwise("draw")
    low, high = num.confidence_95(r, rd)
    return _t(spark, d, "orders").select(
        "o_orderkey", days.alias("days"), F.round(num.inflated_rd(rd, days), 9).alias("grown"), num.edited_rd(rd).alias("edited"), num.is_provisional(rd).alias("provisional"),
        low.alias("low"), high.alias("high"), F.round(num.spread_factor(rd), 9).alias("factor"), tx.result_word_score(word).alias("score"),
    )


@query(f"""with x as (select event_id, value, {CLASS.format("value")} as b from events where value is not null)
select event_id, b::int as bucket, list_value(0.5, 3, 12.5, 40, 105, 225, 400)[b + 1]::double as center, case when b < 6 then list_value(1, 4, 15, 40, 90, 150)[b + 1]::double end as width, (b + 1)::int as reachable, (value - 100) / 50 as z, round((ln(1 + value) - 4) / 2, 9) as log_z from x""")
def q69_bucket_features(spark, d):
    bounds = F.array(*map(F.lit, BOUNDS))
    e = _t(spark, d, "events").filter("value is not null").withColumn("bucket", num.bucket_index(F.col("value"), bounds))
    reachable = F.aggregate(num.bucket_mask(F.col("bucket"), len(BOUNDS) - 1), F.lit(0), lambda s, x: s + x)
    return e.select(
        "event_id", "bucket", num.bucket_center(F.col("bucket"), bounds, 400.0).alias("center"), num.bucket_width(F.col("bucket"), bounds).alias("width"),
        reachable.alias("reachable"), num.z_score(F.col("value"), 100, 50).alias("z"), F.round(num.log_z_score(F.col("value"), 4, 2), 9).alias("log_z"),
    )


@query("""with e as (select vec_id, label, exp(embedding[1]::double) as w, exp(embedding[2]::double) as d, exp(embedding[3]::double) as b from embeddings), p as (select vec_id, label, w / (w + d + b) as w, d / (w + d + b) as d, b / (w + d + b) as b from e)
select vec_id, round(w - b + 0.5 * d, 9) as published, round(w - b, 9) as balanced, round(case when label % 2 = 0 then w else b end + 0.5 * d, 9) as expected, case when w - b > 0.1 then 'White is better' when w - b < -0.1 then 'Black is better' else 'Position is equal' end as assessment from p""")
def q70_evaluations(spark, d):
    p = _t(spark, d, "embeddings").select("vec_id", "label", num.softmax(F.slice("embedding", 1, 3)).alias("p"))
    w, draw, b = (F.get("p", F.lit(i)) for i in range(3))
    side, balanced = F.when(F.col("label") % 2 == 0, "w").otherwise("b"), num.balanced_evaluation(w, b)
    return p.select(
        "vec_id", F.round(num.scalar_evaluation(w, draw, b), 9).alias("published"), F.round(balanced, 9).alias("balanced"),
        F.round(num.expected_for_side(w, draw, b, side), 9).alias("expected"), num.assessment(balanced).alias("assessment"),
    )


@query("""with c as (select user_id, event_type as move, count(*)::double as n from events group by 1, 2), p as (select user_id, move, n / sum(n) over (partition by user_id) as p from c), r as (select *, row_number() over (partition by user_id order by p desc, move) as place from p), t as (select *, max(p) over (partition by user_id) as most from r where place <= 3)
select user_id, move, p from t where p >= 0.25 or most < 0.25""")
def q71_likely_moves(spark, d):
    per = agg.count_by(_t(spark, d, "events"), "user_id", "event_type")
    shares = F.map_from_entries(F.collect_list(F.struct("event_type", F.col("cnt").cast("double"))))
    users = per.groupBy("user_id").agg(shares.alias("counts"), F.sum("cnt").alias("total"))
    likeliest = num.top_entries(F.transform_values("counts", lambda k, n: n / F.col("total")), 3)
    return users.select("user_id", F.explode(num.keep_likely(likeliest, 0.25)).alias("m")).select("user_id", "m.move", "m.p")


@query("""with q as (select quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) as p from orders where o_totalprice >= 100000)
select unnest(list_concat([100000.0], list_transform(p, lambda x: round(x)), ['infinity'::double])) as bound from q""")
def q72_equal_bounds(spark, d):
    return agg.equal_probability_bounds(_t(spark, d, "orders"), "o_totalprice", 100000, 5).select(F.explode("bounds").alias("bound"))


@query("select event_type, count(*) as n from events where event_id % 100 >= 90 group by 1")
def q73_late_positions(spark, d):
    move = F.when(F.col("event_id") % 100 == 0, "x").otherwise((F.col("event_id") % 100).cast("string"))
    e = _t(spark, d, "events").select("event_type", F.concat(F.lit("8/8/8/8/8/8/8/8 w - - 0 "), move).alias("fen"))
    return filters.late_positions(e, "fen", 90).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with c as (select user_id, event_type as move, count(*) as n from events group by 1, 2), u as (select *, sum(n) over (partition by user_id order by move) as upto, sum(n) over (partition by user_id) as total from c)
select user_id, arg_min(move, upto) as move, arg_min(n, upto)::double / any_value(total) as probability, any_value(total)::bigint as total from u where upto > {_UNIT} * total group by 1""")
def r04_drawn_moves(spark, d):
    per = agg.count_by(_t(spark, d, "events"), "user_id", "event_type")
    maps = per.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "cnt")))).alias("moves"))
    return serving.draw_move(maps, "user_id", 11).select("user_id", "move", "probability", "total")


@query("select event_id, value from events order by md5('7:' || event_id), event_id limit 500")
def r01_seeded_sample(spark, d):
    return seq.seeded_sample(_t(spark, d, "events").select("event_id", "value"), 500, 7, "event_id")


@query(f"""with c as (select user_id, event_type, count(*) as n from events group by 1, 2), u as (select *, sum(n) over (partition by user_id order by event_type) as upto, sum(n) over (partition by user_id) as total from c)
select user_id, min(event_type) as event_type from u where upto > {_UNIT} * total group by 1""")
def r02_weighted_choice(spark, d):
    return seq.weighted_choice(agg.count_by(_t(spark, d, "events"), "user_id", "event_type"), "user_id", "event_type", "cnt", 11)


@query("select event_id, user_id, row_number() over (order by md5('3:' || event_id), event_id) as place from events")
def r03_seeded_shuffle(spark, d):
    return seq.seeded_rank(_t(spark, d, "events").select("event_id", "user_id"), 3, "event_id")


def _event_plies(spark, d):
    """Events as the plies of games, one game a user; positions, clocks, ratings and results follow from the keys."""
    e = _t(spark, d, "events")
    e = e.withColumn("ply", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).withColumn("u", F.col("user_id"))
    fen = lambda name: F.concat(F.lit(name), (F.col("event_id") % 97).cast("string"), F.lit(" w - - 0 "), F.col("ply").cast("string"))
    result = F.when(F.col("u") % 4 == 0, "1-0").when(F.col("u") % 4 == 1, "0-1").when(F.col("u") % 4 == 2, "1/2-1/2").otherwise("*")
    return e.select(
        F.col("user_id").alias("game_id"), "ply", F.when(F.col("ply") % 2 == 1, "w").otherwise("b").alias("side"), F.col("event_type").alias("uci"), fen("p").alias("fen_before"), fen("q").alias("fen_after"),
        F.when(F.col("event_id") % 11 != 0, F.floor("value").cast("double")).alias("clk"), (1400 + F.col("u") % 6 * 100).cast("int").alias("white_elo"),
        F.when(F.col("u") % 13 != 0, 1450 + F.col("u") % 5 * 120).cast("int").alias("black_elo"), result.alias("result"), F.when(F.col("u") % 9 == 0, "Abandoned").otherwise("Normal").alias("termination"),
        F.lit(300.0).alias("initial_time"), F.lit(238.0).alias("increment"),
    )


_PLIES = """p as (select user_id as game_id, ply, case when ply % 2 = 1 then 'w' else 'b' end as side, event_type as uci, 'p' || (event_id % 97) || ' w - - 0 ' || ply as fen_before, 'q' || (event_id % 97) || ' w - - 0 ' || ply as fen_after,
case when event_id % 11 <> 0 then floor(value)::double end as clk, (1400 + user_id % 6 * 100)::int as white_elo, case when user_id % 13 <> 0 then (1450 + user_id % 5 * 120)::int end as black_elo,
case user_id % 4 when 0 then '1-0' when 1 then '0-1' when 2 then '1/2-1/2' else '*' end as result, case when user_id % 9 = 0 then 'Abandoned' else 'Normal' end as termination, 300.0::double as initial_time, 238.0::double as increment
from (select *, (row_number() over (partition by user_id order by event_id))::int as ply from events))"""
_OBSERVED = f"""with {_PLIES}, h as (select *, list(uci) over (partition by game_id order by ply rows between 12 preceding and 1 preceding) as recent from p where white_elo between 0 and 1800 and black_elo between 0 and 1800 and termination in ('Normal', 'Time forfeit')),
o as (select to_json(list_append(coalesce(recent, []), fen_before))::varchar as pos_key, fen_before, uci as move, printf('%.1f', coalesce(clk, 0)) as clock, case side when 'w' then white_elo else black_elo end as rating from h where ply > 4 and coalesce(clk, 0) >= 20)"""


def _observed(spark, d):
    from .plans import records

    return records.move_observations(_event_plies(spark, d), high=1800, min_ply=4, min_clock=20.0)


@query(f"""with {_PLIES}, h as (select *, list(uci) over (partition by game_id order by ply rows between 11 preceding and current row) as recent, last_value(case when side = 'b' then clk end ignore nulls) over w as black, last_value(case when side = 'w' then clk end ignore nulls) over w as white
from p where black_elo is not null window w as (partition by game_id order by ply rows between unbounded preceding and 1 preceding)), k as (select *, lag(clk) over (partition by game_id, side order by ply) as before from h where clk is not null)
select game_id, ply, fen_before as fen, array_to_string(recent, ',') as recent_moves, case side when 'w' then white_elo else black_elo end as rating, coalesce(before, initial_time) as player_clock, coalesce(case side when 'w' then black else white end, initial_time) as opponent_clock, increment,
greatest(coalesce(before, initial_time) + increment - clk, 0) as thinking_time from k where game_id not in (select game_id from k where clk - before >= 2 * increment)""")
def g01_clock_records(spark, d):
    from .plans import records

    return records.clock_records(_event_plies(spark, d)).withColumn("recent_moves", F.array_join("recent_moves", ","))


@query(f"""with {_PLIES}, h as (select *, list(uci) over (partition by game_id order by ply rows between 11 preceding and current row) as recent, last_value(case when side = 'b' then clk end ignore nulls) over w as black, last_value(case when side = 'w' then clk end ignore nulls) over w as white
from p where result in ('1-0', '0-1') and (white_elo + black_elo) // 2 between 1500 and 1700 window w as (partition by game_id order by ply rows between unbounded preceding and current row))
select game_id, ply, fen_after as fen, array_to_string(recent, ',') as recent_moves, case result when '1-0' then 1 else -1 end as winner, white_elo, black_elo, coalesce(white, 300) as white_clock, coalesce(black, 300) as black_clock, increment from h where clk is not null""")
def g02_winner_records(spark, d):
    from .plans import records

    return records.winner_records(_event_plies(spark, d), low=1500, high=1700, with_draws=False).withColumn("recent_moves", F.array_join("recent_moves", ","))


@query(f"{_OBSERVED} select pos_key, move, clock, rating, count(*) as cnt from o group by all")
def g03_move_histogram(spark, d):
    return _observed(spark, d)


@query(f"""{_OBSERVED}, f as (select array_to_string(string_split(fen_before, ' ')[1:4], ' ') as fen, move, count(*) as n from o group by all)
select fen, '{{' || string_agg('"' || move || '":' || n, ',' order by move) || '}}' as moves, sum(n)::bigint as total from f group by 1 having sum(n) > 15""")
def g04_common_positions(spark, d):
    from .plans import records

    return records.common_positions(_observed(spark, d), 15).select("fen", F.to_json("moves").alias("moves"), "total")


@query(f"""with {_PLIES}, h as (select *, count(*) over (partition by game_id) as n, list(uci) over w as history, last_value(case when side = 'w' then clk end ignore nulls) over w as white, last_value(case when side = 'b' then clk end ignore nulls) over w as black,
case side when 'w' then white_elo else black_elo end as elo_self, case side when 'w' then black_elo else white_elo end as elo_oppo from p window w as (partition by game_id order by ply rows between unbounded preceding and 1 preceding)),
b as (select *, case when elo_self >= 1400 and elo_self < 1650 then 'low' when elo_self >= 1650 and elo_self < 2000 then 'high' end as elo_band from h where n >= 40 and ply > 10), r as (select *, row_number() over (partition by elo_band order by game_id, ply) as place from b where elo_band is not null)
select game_id, ply, fen_before as fen, uci as played_move, side, elo_self, elo_oppo, white_elo, black_elo, coalesce(white, 300) as white_clock, coalesce(black, 300) as black_clock, increment, array_to_string(history, ',') as move_history, elo_band,
case result when '1/2-1/2' then 0.5 when '1-0' then (side = 'w')::int when '0-1' then (side = 'b')::int end::double as result_for_side from r where place <= 400""")
def g08_eval_records(spark, d):
    bands = [(1400, 1650, "low"), (1650, 2000, "high")]
    return ev.balanced_set(ev.eval_records(_event_plies(spark, d), bands, skip_plies=10, min_plies=40), 400).withColumn("move_history", F.array_join("move_history", ","))


_OPENINGS = {
    "1. e4 e5 2. Nf3 Nc6 3. Bb5 a6 4. Ba4 Nf6 5. O-O Be7": "e2e4 e7e5 g1f3 b8c6 f1b5 a7a6 b5a4 g8f6 e1g1 f8e7",
    "1. d4 d5 2. c4 dxc4 3. e4 b5 4. a4 c6": "d2d4 d7d5 c2c4 d5c4 e2e4 b7b5 a2a4 c7c6",
    "1. e4 d5 2. e5 f5 3. exf6 Nxf6 4. Bb5+ c6": "e2e4 d7d5 e4e5 f7f5 e5f6 g8f6 f1b5 c7c6",
}


@query(f"""with g as (select c_custkey, list_value({", ".join(f"'{u}'" for u in _OPENINGS.values())})[(c_custkey % 3 + 1)::int] as line from customer), m as (select c_custkey, unnest(string_split(line, ' ')) as uci, generate_subscripts(string_split(line, ' '), 1) as ply from g)
select c_custkey, ply::int as ply, case when ply % 2 = 1 then 'w' else 'b' end as side, uci, (300 - ply - c_custkey % 60)::double as clk from m""")
def g09_replayed_games(spark, d):
    """Games whose texts are put together from customers: an opening, and clocks that follow from the key."""
    from .plans import records

    line = F.element_at(F.array(*map(F.lit, _OPENINGS)), (F.col("c_custkey") % 3 + 1).cast("int"))
    clock = lambda n: F.concat(F.lit(" {[%clk "), tx.hms(300 - n - F.col("c_custkey") % 60), F.lit("]} "))
    sans = F.filter(F.split(line, " "), lambda t: ~t.rlike(r"^\d+\.$"))
    text = F.array_join(F.transform(sans, lambda t, i: F.concat(t, clock(i + 1))), " ")
    # The table is one small file, and replaying is work: keys are dealt, texts are made where they are replayed.
    games = _t(spark, d, "customer").select("c_custkey").repartition(spark.sparkContext.defaultParallelism, "c_custkey")
    return records.plies(games.select(F.col("c_custkey").alias("game_id"), text.alias("movetext"))).select(F.col("game_id").alias("c_custkey"), "ply", "side", "uci", "clk")


_SCORED = "select o_custkey::varchar as key, o_orderkey as game_no, row_number() over (partition by o_custkey order by o_orderkey) as n, 1200.0::double + o_orderkey % 800 as o, (o_orderkey % 3) / 2.0::double as s from orders"


@query(rating_fold(_SCORED, {"w_": ("g.o", "80.0", "g.s")}) + " select key as player, game_no, w_r as rating, w_rd as rd, w_vol as volatility, greatest(round_even(w_r, 0), 600)::bigint as listed from h where done and n > 0")
def g05_rated_games(spark, d):
    from .streaming.ratings import rate_games

    o = _t(spark, d, "orders")
    return rate_games(o.select(F.col("o_custkey").cast("string").alias("player"), F.col("o_orderkey").alias("game_no"), (1200 + F.col("o_orderkey") % 800).cast("double").alias("opponent_rating"), F.lit(80.0).alias("opponent_rd"), ((F.col("o_orderkey") % 3) / 2.0).alias("score")))


@query("""with recursive g as (select o_custkey::varchar as user_id, o_orderkey as game_no, row_number() over (partition by o_custkey order by o_orderkey) as n, epoch(o_orderdate)::bigint as moment, 1200.0::double + o_orderkey % 800 as opponent, (o_orderkey % 3) / 2.0::double as s, ln(10) / 400 as q, 1 / sqrt(1 + 3 * (ln(10) / 400 * 50 / pi()) ** 2) as f from orders),
h as (select distinct user_id, 0::bigint as n, null::bigint as game_no, null::bigint as played, null::double as rating_before, null::double as rd_before, 1500.0::double as rating, 350.0::double as rd, null::double as change, 0::bigint as games_played, 0::bigint as wins, 0::bigint as losses, 0::bigint as draws from g
union all select user_id, n, game_no, moment, rating, rd0, round(least(greatest(rating + gain, 100), 3500), 1), round(least(greatest(1 / sqrt(p), 30), 350), 1), round(gain, 1), games_played + 1, wins + (s = 1)::int, losses + (s = 0)::int, draws + (s = 0.5)::int from
(select *, q / p * f * (s - e) as gain from (select *, 1 / rd0 ** 2 + q * q * f * f * e * (1 - e) as p from (select g.*, h.rating, games_played, wins, losses, draws, 1 / (1 + 10 ** (-f * (h.rating - opponent) / 400)) as e,
case when floor((moment - played) / 86400) > 0 then least(350, round(sqrt(h.rd * h.rd + 34.64 * floor((moment - played) / 86400)), 1)) else h.rd end as rd0 from h join g on g.user_id = h.user_id and g.n = h.n + 1))))
select user_id, game_no, rating_before, rd_before, rating, rd, change, games_played, wins, losses, draws from h where n > 0""")
def g06_user_history(spark, d):
    from .streaming.ratings import user_history

    o = _t(spark, d, "orders")
    return user_history(o.select(F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderkey").alias("game_no"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("played_at"), (1200 + F.col("o_orderkey") % 800).cast("double").alias("opponent_rating"), F.lit(50.0).alias("opponent_rd"), ((F.col("o_orderkey") % 3) / 2.0).alias("score")))


@query(rating_fold(_SCORED, {"w_": ("h.b_r", "h.b_rd", "g.s"), "b_": ("h.w_r", "h.w_rd", "1 - g.s")}) + " select key as match_id, game_no, 'a' as white, 'b' as black, w_r as white_rating, w_rd as white_rd, b_r as black_rating, b_rd as black_rd from h where done and n > 0")
def g07_match_ratings(spark, d):
    from .streaming.ratings import rate_matches

    o = _t(spark, d, "orders")
    return rate_matches(o.select(F.col("o_custkey").cast("string").alias("match_id"), F.col("o_orderkey").alias("game_no"), F.lit("a").alias("white"), F.lit("b").alias("black"), ((F.col("o_orderkey") % 3) / 2.0).alias("score")))


@query("""select o_orderkey, case when o_totalprice / 50 < 100 or o_totalprice / 50 > 3500 then 'bot_rating: out of range' when o_custkey % 5 = 0 then 'player_color: missing' when o_orderstatus not in ('F', 'O') then 'player_color: not allowed' when o_orderpriority like '%URGENT' then 'result: not allowed' end as reason from orders""")
def q74_request_reasons(spark, d):
    status = F.col("o_orderstatus")
    colour = F.when(F.col("o_custkey") % 5 != 0, F.when(status == "F", "white").when(status == "O", "black").otherwise("green"))
    o = _t(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 50).alias("bot_rating"), colour.alias("player_color"), F.when(F.col("o_orderpriority").endswith("URGENT"), "won").otherwise("win").alias("result"))
    return o.select("o_orderkey", filters.request_reason("bot_rating", "player_color", "result").alias("reason"))


@query("""with e as (select o_custkey, arg_max(o_totalprice / 50, o_orderkey) as r from orders where o_totalprice / 50 between 100 and 3500 group by 1), u as (select c_custkey, 800.0 + c_custkey % 1800 as rating, 40.0 + c_custkey % 320 as rd from customer where c_custkey % 7 <> 0)
select coalesce(c_custkey, o_custkey) as user_id, coalesce(r, rating)::double as rating, case when r is null then rd else least(350, coalesce(rd, 350) + 50) end::double as rd from u full join e on c_custkey = o_custkey""")
def q75_rating_edits(spark, d):
    users = _t(spark, d, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("user_id"), (800.0 + F.col("c_custkey") % 1800).alias("rating"), (40.0 + F.col("c_custkey") % 320).alias("rd"))
    edits = _t(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_totalprice") / 50).alias("new_rating"), F.col("o_orderkey").alias("edited_at"))
    return serving.edited_ratings(users, edits)


@query("""select *, score_percent - expected_percent as beyond_percent from (select o_orderpriority, avg((o_orderkey % 3) / 2.0) * 100 as score_percent, 100 / (1 + pow(10, (avg(o_custkey) - 600) / 400)) as expected_percent from orders group by 1)""")
def q76_elo_expectation(spark, d):
    o = _t(spark, d, "orders").select("o_orderpriority", ((F.col("o_orderkey") % 3) / 2.0).alias("score"), F.lit(1).alias("n_moves"), "o_custkey")
    played = ev.match_summary(o, "o_orderpriority").join(o.groupBy("o_orderpriority").agg(F.lit(600.0).alias("first"), F.avg("o_custkey").alias("second")), "o_orderpriority")
    return ev.with_expectation(played, "first", "second").select("o_orderpriority", "score_percent", "expected_percent", "beyond_percent")


@query("select event_id, (case when event_id % 3 = 0 then 0 when event_id % 3 = 1 then 1 else 2 end)::int as class from events")
def q77_result_classes(spark, d):
    result = F.when(F.col("event_id") % 3 == 0, "0-1").when(F.col("event_id") % 3 == 1, "1/2-1/2").otherwise("1-0")
    return _t(spark, d, "events").select("event_id", tx.result_class(tx.result_label(result)).alias("class"))


@query(f"""with n as (select {CLASS.format("value")} as bucket, round_even(value, 0) as second, count(*) as n from events where value is not null group by 1, 2), c as (select *, sum(n) over (partition by bucket order by second) as upto, sum(n) over (partition by bucket) as total from n),
r as (select event_id, {CLASS.format("value")} as bucket, ('0x' || substr(md5('5:' || event_id), 1, 13))::bigint / 4503599627370496.0 as u from events where value is not null)
select event_id, min(second)::double as seconds from r join c using (bucket) where upto > u * total group by 1""")
def q78_drawn_seconds(spark, d):
    e = _t(spark, d, "events").filter("value is not null").withColumn("bucket", agg.bucket_of(F.col("value"), BOUNDS))
    per = agg.second_shares(e, "bucket", "value").groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct(F.col("second").cast("string"), F.col("n").cast("double")))).alias("distribution"))
    return serving.draw_seconds(e.select("event_id", "bucket"), "event_id", "bucket", per, 5).select("event_id", "seconds")


@query("""with g as (select user_id, value, event_id from events), t as (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as r, value from g)
select user_id::varchar as fen, '' as recent_moves, '1100-1500' as rating_pair, printf('%.6f', max(floor(value))) as total_variation_distance, string_agg('m' || r || ':' || printf('%.4f', floor(value)), '; ' order by r) filter (where r <= 2) as top5_lower_rating, '' as top5_higher_rating, case when user_id % 2 = 0 then 'True' else 'False' end as in_lower_common_moves, 'False' as in_higher_common_moves from t group by user_id""")
def q79_gap_report(spark, d):
    from .sources import reports

    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    t = _t(spark, d, "events").withColumn("r", F.row_number().over(w)).withColumn("p", F.floor("value").cast("double"))
    top = F.array_sort(F.collect_list(F.when(F.col("r") <= 2, F.struct("r", F.concat(F.lit("m"), F.col("r").cast("string")).alias("move"), "p"))))
    per = t.groupBy("user_id").agg(F.max("p").alias("gap"), F.transform(top, lambda x: F.struct(x["move"].alias("move"), x["p"].alias("p"))).alias("low_top"))
    empty = F.array().cast("array<struct<move:string,p:double>>")
    return reports.gap_report(per.select(F.col("user_id").cast("string").alias("fen"), F.lit(None).cast("array<string>").alias("history"), F.lit(1100).alias("low"), F.lit(1500).alias("high"), "gap", "low_top", empty.alias("high_top"), (F.col("user_id") % 2 == 0).alias("in_low"), F.lit(None).cast("boolean").alias("in_high")))


@query("""with b as (select o_orderkey * 10 as lo, o_orderkey * 10 + 3 + o_custkey % 9 as hi, o_orderstatus || o_orderkey as name from orders), p as (select l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber * 2 - 4 as v from lineitem)
select l_orderkey, l_linenumber, v, case when v < hi then name end as band from p asof left join b on p.v >= b.lo""")
def q80_interval_join(spark, d):
    """Points in a table of bands, one an order: no list of bands in the plan, no nested loop."""
    bands = _t(spark, d, "orders").select((F.col("o_orderkey") * 10).alias("lo"), (F.col("o_orderkey") * 10 + 3 + F.col("o_custkey") % 9).alias("hi"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("band"))
    points = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber") * 2 - 4).alias("v"))
    return joins.in_intervals(points, "v", bands, "lo", "hi").select("l_orderkey", "l_linenumber", "v", "band")


@query("""with b as (select o_orderkey * 10 as lo, o_orderkey * 10 + 3 + o_custkey % 5 as hi, o_orderkey as name from orders where o_orderkey % 3 = 0), p as (select l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber * 2 as v from lineitem),
l as (select p.*, b.name as n1, case when v < hi then 0 else v - hi + 1 end as d1 from p asof left join b on p.v >= b.lo), h as (select l.*, b.name as n2, b.lo - v as d2 from l asof left join b on l.v < b.lo)
select l_orderkey, l_linenumber, case when n2 is null or d1 <= d2 then n1 else n2 end as model, (case when n2 is null or d1 <= d2 then d1 else d2 end)::double as distance from h""")
def q81_nearest_interval(spark, d):
    o = _t(spark, d, "orders").filter("o_orderkey % 3 = 0")
    registry = o.select((F.col("o_orderkey") * 10).alias("low"), (F.col("o_orderkey") * 10 + 3 + F.col("o_custkey") % 5).alias("high"), F.col("o_orderkey").alias("name"))
    points = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber") * 2).alias("v"))
    return serving.nearest_registered(points, registry, "v").select("l_orderkey", "l_linenumber", "model", "distance")


#: Half of all events are one user's: the group that scans deal out by ranges.
_HOT = "(select *, case when event_id % 2 = 0 then 0 else user_id end as u from events)"


def _hot_events(spark, d):
    return _t(spark, d, "events").withColumn("u", F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("user_id")))


@query(f"""select event_id, sum(floor(value)) over w as total, max(value) over w as maximum, lag(value) over (partition by u order by event_id) as before,
coalesce(string_agg(event_type, ',') over (partition by u order by event_id rows between 4 preceding and current row), '') as h from {_HOT} window w as (partition by u order by event_id rows between unbounded preceding and current row)""")
def q82_scan_hot_group(spark, d):
    """Sums, maxima, the value before and the last five types of a group on half of all rows, no task over a range of it."""
    value = F.col("value")
    scans = Scan("total", "sum", F.floor("value").cast("double")), Scan("maximum", "max", value), Scan("before", "rows", value, 1, with_current=False), Scan("h", "rows", F.col("event_type"), 5)
    found = scan(_hot_events(spark, d), ["u"], ["event_id"], *scans, max_group=1000)
    return found.select("event_id", "total", "maximum", F.get("before", 0).alias("before"), F.array_join("h", ",").alias("h"))


@query(f"""select u, event_id, last_value(case when event_id % 3 = 0 then value end ignore nulls) over w as white_clock, last_value(case when event_id % 3 <> 0 then value end ignore nulls) over w as black_clock
from {_HOT} window w as (partition by u order by event_id rows between unbounded preceding and current row)""")
def q83_clocks_at(spark, d):
    plies = _hot_events(spark, d).select("u", F.col("event_id").alias("ply"), F.when(F.col("event_id") % 3 == 0, "w").otherwise("b").alias("side"), F.col("value").alias("clk"))
    return serving.clocks_at(plies, "u", max_group=1000).select("u", F.col("ply").alias("event_id"), "white_clock", "black_clock")


def _race(seed: int, keys: str, weight: str) -> str:
    return f"-ln(1 - ('0x' || substr(md5('{seed}:' || {keys}), 1, 13))::bigint / 4503599627370496.0) / {weight}"


@query(f"select event_type, user_id from (select event_type, user_id, row_number() over (partition by event_type order by {_race(21, "event_type || ':' || user_id", 'n')}, user_id) as r from (select event_type, user_id, sum(floor(value)) as n from events group by 1, 2) where n > 0) where r = 1")
def r05_weighted_draw(spark, d):
    """One user a type, in proportion to the sum of values, drawn by an aggregate."""
    per = _t(spark, d, "events").groupBy("event_type", "user_id").agg(F.sum(F.floor("value")).cast("double").alias("n"))
    return seq.weighted_draw(per, "event_type", "user_id", "n", 21)


@query(f"select event_type, user_id, r::int as place from (select event_type, user_id, row_number() over (partition by event_type order by {_race(22, "event_type || ':' || user_id", 'n')}, user_id) as r from (select event_type, user_id, count(*) as n from events group by 1, 2)) where r <= 20")
def r06_weighted_draws(spark, d):
    return seq.weighted_draws(agg.count_by(_t(spark, d, "events"), "event_type", "user_id"), "event_type", "user_id", "cnt", 20, 22)


@query("""with u as (select event_id, ('0x' || substr(md5('31:' || event_id), 1, 13))::bigint / 4503599627370496.0 as u from events)
select event_id, 10 + u * (30 - 10) as inside, 60 - 12.5 * ln(1 - u) as beyond from u""")
def q84_bucket_times(spark, d):
    """A time inside a bucket, and one beyond the last bound."""
    u = num.seeded_unit(31, F.col("event_id"))
    return _t(spark, d, "events").select("event_id", num.uniform_between(u, F.lit(10.0), F.lit(30.0)).alias("inside"), num.exponential_tail(u, F.lit(60.0), 12.5).alias("beyond"))


_ASKED = "select event_id, user_id, event_type, event_type || (user_id % 7)::varchar as m, 'p' || (event_id % 11)::varchar || ' w - - 0 ' || (event_id % 3)::varchar as fen from events"


@query(f"""with r as ({_ASKED}), x as (select *, '[["' || event_type || '","' || m || '"],"' || fen || '"]' as by_history, regexp_replace(fen, ' [0-9]+ [0-9]+$', '') as by_position from r),
a as (select by_history as key, count(*) as n from x where event_id % 5 = 0 group by 1), b as (select by_position as key, count(*) as n from x where event_id % 11 < 4 and event_id % 2 = 0 group by 1), c as (select fen as key, count(*) as n from x where event_id % 11 < 7 and event_id % 3 = 1 group by 1)
select event_id, coalesce(a.n, b.n, c.n)::bigint as total, case when a.n is not null then 'history' when b.n is not null then 'position' when c.n is not null then 'full position' else 'not found' end as strategy
from x left join a on x.by_history = a.key left join b on x.by_position = b.key left join c on x.fen = c.key""")
def q85_served_moves(spark, d):
    """Requests of a history and a position, looked up in four tables in one join."""
    e = _t(spark, d, "events")
    m = F.concat("event_type", (F.col("user_id") % 7).cast("string"))
    fen = F.concat(F.lit("p"), (F.col("event_id") % 11).cast("string"), F.lit(" w - - 0 "), (F.col("event_id") % 3).cast("string"))
    asked = e.select("event_id", fen.alias("fen"), F.array("event_type", m).alias("history"))
    counts = lambda rows, key: rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select("key", F.create_map(F.lit("e2e4"), "n").alias("moves"))
    by_history = counts(asked.filter("event_id % 5 = 0"), F.concat(F.lit("["), F.to_json("history"), F.lit(',"'), F.col("fen"), F.lit('"]')))
    by_position = counts(asked.filter("event_id % 11 < 4 and event_id % 2 = 0"), tx.strip_counters(F.col("fen")))
    by_fen = counts(asked.filter("event_id % 11 < 7 and event_id % 3 = 1"), F.col("fen"))
    found = serving.lookup_moves(asked, by_history, by_position, by_fen, by_fen.filter("false"))
    return found.select("event_id", F.element_at("moves", "e2e4").alias("total"), "strategy")


def _event_files(spark, d, **options) -> str:
    """Events as JSON records in eight files of the shared folder, in the order of their ids; the file names' pattern."""
    import uuid

    from .operators.ordered import shared_folder
    from .sources import record_files, records

    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}/events@.{'bag' if options.pop('plain', False) else 'bagz'}"
    return record_files.write_files(records.json_records(_t(spark, d, "events").select("event_id", "user_id", "event_type")), path, order=["event_id"], shards=8, **options)


@query("select global_idx, event_id, user_id, event_type from (select *, row_number() over (order by event_id) - 1 as global_idx, count(*) over () as n from events) where global_idx >= n // 3 and global_idx < n // 2")
def q86_record_range(spark, d):
    """A range of the records of eight files, read by their offsets."""
    from .sources import record_files, records

    n = _t(spark, d, "events").count()
    rows = record_files.read_files(spark, _event_files(spark, d), rows_per_task=2000).filter(F.col("global_idx").between(n // 3, n // 2 - 1))
    return records.parsed_records(rows.select("global_idx", "record"), "event_id long, user_id long, event_type string")


@query("select wanted, event_id, event_type from (select *, row_number() over (order by event_id) - 1 as global_idx from events) e join (select distinct user_id * 37 as wanted from events) on wanted = global_idx")
def q87_record_look_up(spark, d):
    """Many records by their index over all files: an interval join with the files' index, then reads of what is asked for."""
    from .sources import record_files, records

    path = _event_files(spark, d, plain=True, limits="separate")
    wanted = _t(spark, d, "events").select((F.col("user_id") * 37).alias("wanted")).distinct()
    rows = record_files.look_up(wanted, record_files.file_index(spark, path, limits="separate"), column="wanted", limits="separate")
    return records.parsed_records(rows.select("wanted", "record"), "event_id long, event_type string")


@query("select source, count(*) as n, sum(event_id)::bigint as ids, min(global_idx) as first from (select event_id, row_number() over (order by event_id) - 1 as global_idx, case when row_number() over (order by event_id) >= 0 then 'all' end as source from events) group by 1")
def q88_merged_records(spark, d):
    """Eight files joined to three without decoding, and read again."""
    from .sources import record_files, records

    path = _event_files(spark, d)
    merged = path.rsplit("/", 1)[0] + "/merged@3.bagz"
    record_files.merge_files(spark, [path], merged)
    rows = records.parsed_records(record_files.read_files(spark, merged).select("global_idx", "record"), "event_id long")
    return rows.groupBy(F.lit("all").alias("source")).agg(F.count("event_id").alias("n"), F.sum("event_id").alias("ids"), F.min("global_idx").alias("first"))


@query("""with e as (select 'p' || (case when event_id % 2 = 0 then 0 else event_id % 50 end) as fen, value from events where value is not null), n as (select *, row_number() over (partition by fen order by value) as n from e)
select fen, ((n - 1) // 1000)::int as part, count(*) as count, string_agg(floor(value)::bigint::varchar, ',' order by value) as times from n group by 1, 2""")
def q89_position_parts(spark, d):
    """Observations of positions, one on half of all rows, in parts of 1,000."""
    from .sources import reports

    fen = F.concat(F.lit("p"), F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("event_id") % 50).cast("string"))
    zero = F.lit(0.0)
    records = _t(spark, d, "events").filter("value is not null").select(fen.alias("fen"), F.col("value").alias("thinking_time"), zero.alias("player_clock"), zero.alias("opponent_clock"), zero.alias("increment"), F.lit(0).alias("rating"))
    parts = reports.position_parts(records, with_history=False, part_rows=1000, max_group=1000)
    return parts.select("fen", "part", "count", F.array_join(F.transform("thinking_times", lambda x: F.floor(x).cast("string")), ",").alias("times"))


@query("select event_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"value\":' || printf('%.6f', value) || '}' as record from events where value is not null")
def q90_fixed_decimals(spark, d):
    from .sources import records

    rows = records.fixed_json_records(_t(spark, d, "events").filter("value is not null").select("event_id", "event_type", "value"), {"value": 6})
    return rows.select("event_id", F.decode("record", "UTF-8").alias("record"))


from . import catalog_games  # noqa: E402, F401  its queries use the decorator above
