"""What the service computes per request, for tables of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import text as tx
from ..operators import filters, joins
from ..operators import sequences as seq


def lookup_moves(requests: DataFrame, by_history: DataFrame, by_position: DataFrame, by_fen: DataFrame, direct: DataFrame) -> DataFrame:
    """`requests` (fen, history) with the move counts of the first table that knows them, and its name in `strategy`.

    Tables hold `key` (once each) and `moves` (map of counts): by `[[moves],fen]` as compact JSON, by position without counters,
    by full position, and by the key as it is stored. A null history is not looked up.
    """
    key = F.concat(F.lit("["), F.to_json("history"), F.lit(',"'), F.col("fen"), F.lit('"]'))
    keyed = requests.withColumn("__history", key).withColumn("__position", tx.strip_counters(F.col("fen"))).withColumn("__fen", F.col("fen"))
    steps = [("history", by_history, "__history", "moves"), ("position", by_position, "__position", "moves"), ("full position", by_fen, "__fen", "moves"), ("direct", direct, "__fen", "moves")]
    return joins.cascade(keyed, steps, "moves", "strategy").drop("__history", "__position", "__fen")


def edited_ratings(ratings: DataFrame, edits: DataFrame) -> DataFrame:
    """`ratings` (user_id, rating, rd, ...) after the users' own edits (user_id, new_rating, edited_at).

    A user's last edit within the limits counts; the deviation grows with it. Users without a rating begin with the usual one.
    """
    good = edits.filter(filters.request_reason("new_rating").isNull()).groupBy("user_id").agg(F.max_by("new_rating", "edited_at").cast("double").alias("__new"))
    held = ratings.join(good, "user_id", "full")
    rd = F.coalesce("rd", F.lit(num.START_RD))
    done = F.col("__new").isNotNull()
    return held.withColumn("rating", F.coalesce("__new", "rating")).withColumn("rd", F.when(done, num.edited_rd(rd)).otherwise(rd)).drop("__new")


#: Slots that the unit interval is cut into, so that a draw meets the few values of its slot and not all of its bucket.
_SLOTS = 1024


def draw_seconds(requests: DataFrame, request_id: str, bucket: str, distributions: DataFrame, seed: int) -> DataFrame:
    """Adds `seconds`, drawn from the distribution that the request's bucket has: bucket and a map of values (as text) and weights.

    Values lie in a row by their running weights; a value is kept in each slot that its weights touch (one more on either side, for
    rounding), and a request joins its slot and keeps the value on which its mark falls."""
    entries = distributions.select(F.col("bucket").alias("__b"), F.explode("distribution").alias("__key", "__weight")).withColumn("__value", F.col("__key").cast("double"))
    inside = Window.partitionBy("__b").orderBy("__value", "__weight")
    summed = entries.withColumn("__upto", F.sum("__weight").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    summed = summed.withColumn("__before", F.coalesce(F.lag("__upto").over(inside), F.lit(0.0)))
    summed = summed.withColumn("__total", F.last("__upto").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).filter("__upto > __before")
    slot = lambda upto: F.floor(upto / F.col("__total") * _SLOTS)
    slots = F.sequence(F.greatest(slot(F.col("__before")) - 1, F.lit(0)), F.least(slot(F.col("__upto")) + 1, F.lit(_SLOTS - 1)))
    held = summed.select("__b", F.explode(slots).alias("__s"), "__before", "__upto", "__total", F.col("__value").alias("seconds"))
    df = requests.withColumn("__unit", num.seeded_unit(seed, F.col(request_id)))
    mark = F.col("__unit") * F.col("__total")
    met = (F.col(bucket) == F.col("__b")) & (F.floor(F.col("__unit") * _SLOTS) == F.col("__s")) & (mark >= F.col("__before")) & (mark < F.col("__upto"))
    return df.join(held, met, "left").drop("__b", "__s", "__before", "__upto", "__total", "__unit")


def draw_move(requests: DataFrame, request_id: str, seed: int, *, counts: str = "moves") -> DataFrame:
    """Adds `move`, drawn in proportion to the counts by a hash of the request's id, its `probability` and the `total`; null without counts."""
    items = F.array_sort(F.map_entries(F.col(counts)))
    total = F.aggregate(F.map_values(F.col(counts)), F.lit(0).cast("long"), lambda s, x: s + x)
    df = requests.withColumn("total", total).withColumn("__mark", num.seeded_unit(seed, F.col(request_id)) * F.col("total"))
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("string").alias("move"), F.lit(0).cast("long").alias("n"))

    def step(state, item):
        upto = state["upto"] + item["value"]
        take = state["move"].isNull() & (upto > F.col("__mark"))
        return F.struct(upto.alias("upto"), F.when(take, item["key"]).otherwise(state["move"]).alias("move"), F.when(take, item["value"]).otherwise(state["n"]).alias("n"))

    df = df.withColumn("__drawn", F.aggregate(items, start, step))
    return df.withColumn("move", F.col("__drawn.move")).withColumn("probability", F.when(F.col("total") > 0, F.col("__drawn.n") / F.col("total"))).drop("__mark", "__drawn")


def draw_pair(records: DataFrame, record_id: str, seed: int, *, moves: str = "moves") -> DataFrame:
    """Adds move, clock and rating, drawn together in proportion to the counts of move -> clock -> rating -> count maps."""
    of = lambda m, c: F.transform(F.map_entries(c["value"]), lambda r: F.struct(m["key"].alias("move"), c["key"].cast("double").alias("clock"), r["key"].cast("int").alias("rating"), r["value"].cast("long").alias("n")))
    flat = F.array_sort(F.flatten(F.transform(F.map_entries(moves), lambda m: F.flatten(F.transform(F.map_entries(m["value"]), lambda c: of(m, c))))))
    total = F.aggregate(flat, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    df = records.withColumn("__all", flat).withColumn("__mark", num.seeded_unit(seed, F.col(record_id)) * total)
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("struct<move:string,clock:double,rating:int,n:bigint>").alias("x"))

    def step(state, x):
        upto = state["upto"] + x["n"]
        return F.struct(upto.alias("upto"), F.when(state["x"].isNull() & (upto > F.col("__mark")), x).otherwise(state["x"]).alias("x"))

    df = df.withColumn("__x", F.aggregate("__all", start, step)["x"])
    return df.select(*records.columns, F.col("__x.move").alias("move"), F.col("__x.clock").alias("clock"), F.col("__x.rating").alias("rating"))


def chosen_moves(requests: DataFrame, request_id: str, seed: int) -> DataFrame:
    """The answer per request: a move of the common table, else of the model, else the first legal one; null if the game is over.

    Columns: moves (counts or null), probs (the model's map or null), legal (array, sorted), min_probability.
    """
    items = F.transform(F.map_entries("probs"), lambda e: F.struct(e["key"].alias("move"), e["value"].alias("p")))
    likely = num.keep_likely(items, F.col("min_probability"))
    weights = F.map_from_entries(F.transform(likely, lambda m: F.struct(m["move"], F.round(m["p"] * 1e9).cast("long"))))
    common = draw_move(requests, request_id, seed).withColumnRenamed("move", "__common").drop("probability", "total")
    model = draw_move(common.withColumn("__weights", weights), request_id, seed + 1, counts="__weights").withColumnRenamed("move", "__model").drop("probability", "total", "__weights")
    over = F.size("legal") == 0
    source = F.when(over, "game over").when(F.col("__common").isNotNull(), "common_moves").when(F.col("__model").isNotNull(), "model").otherwise("fallback")
    move = F.when(~over, F.coalesce("__common", "__model", F.get("legal", 0)))
    return model.withColumn("source", source).withColumn("move", move).drop("__common", "__model")


def nearest_model(requests: DataFrame, bands: list[tuple[int, int, str]], rating: str = "rating") -> DataFrame:
    """Adds the nearest registered band (`model`) and its distance; the registry is a short list and part of the plan."""
    return joins.nearest_band(requests, rating, bands, "model", "distance")


def nearest_registered(requests: DataFrame, registry: DataFrame, rating: str = "rating") -> DataFrame:
    """As `nearest_model`, for a table of bands (low, high, name) of any size."""
    return joins.nearest_interval(requests, rating, registry, "low", "high", "name", "model", "distance")


def registry_table(names: DataFrame, name: str = "name") -> DataFrame:
    """(low, high, name) of a table of folder names such as `1200_1400`; other names are passed over."""
    bounds = F.regexp_extract(name, r"^(\d+)_(\d+)$", 1), F.regexp_extract(name, r"^(\d+)_(\d+)$", 2)
    return names.filter(F.col(name).rlike(r"^\d+_\d+$")).select(bounds[0].cast("long").alias("low"), bounds[1].cast("long").alias("high"), F.col(name).alias("name"))


def registry_bands(names: list[str]) -> list[tuple[int, int, str]]:
    """(low, high, name) of folder names such as `1200_1400`; other names are passed over."""
    parts = [(n, n.split("_")) for n in names]
    return sorted((int(p[0]), int(p[1]), n) for n, p in parts if len(p) == 2 and all(x.isdigit() for x in p))


def evaluated_positions(requests: DataFrame, bands: list[tuple[int, int, str]]) -> DataFrame:
    """Adds the band of the players' mean rating, the scalar evaluation of (white, draw, black) and its assessment."""
    mean = F.floor((F.col("white_rating") + F.col("black_rating")) / 2)
    df = nearest_model(requests.withColumn("__mean", mean), bands, "__mean").drop("__mean")
    df = df.withColumn("evaluation", num.scalar_evaluation(F.col("white"), F.col("draw"), F.col("black")))
    return df.withColumn("assessment", num.assessment(F.col("evaluation")))


def history_page(history: DataFrame, user: str, offset: int, limit: int, *, user_id: str = "user_id", played_at: str = "played_at") -> tuple[DataFrame, DataFrame]:
    """(a page of one user's games, newest first; one row with the number of all of them)."""
    own = history.filter(F.col(user_id) == user)
    return seq.page(own, [F.desc(played_at), F.desc("game_no")], offset, limit), own.agg(F.count(F.lit(1)).alias("total_count"))


def clocks_at(moves: DataFrame, game_id: str = "game_id", **options) -> DataFrame:
    """Both clocks after each move of a review: the last known of either side."""
    return joins.clocks_upto(moves, game_id, "ply", "side", "clk", **options)
