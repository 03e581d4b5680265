"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

Every document is a stretch of its source's token line, on which the documents lie in a shuffled, seeded order. The
line is cut into blocks of equal token counts (the last of a source is shorter). The points of a golden-ratio sequence
are mapped through the cumulative weights of the sources, which gives slot after slot to a source at an even pace; the
r-th slot of a source takes its block r, starting over when the line ends. DataFrame functions only.

Defined results: a null text or a text of white space has size 0 and takes nothing; null is a source of its own and
comes last; rows that repeat an id count one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, running_start, word_count

GOLDEN = 0.6180339887498949
#: Source tables up to this many rows are broadcast; larger ones are joined by key.
BROADCAST_SOURCES = 10_000
#: The unit interval is divided into so many cells, by which points meet the sources' stretches.
CELLS = 4096


@dataclass
class Mix:
    """documents: a row per input row with its place; sources: targets; slots: the schedule, in order of `slot`."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    block_tokens: int
    small: bool

    def with_sources(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self.sources) if self.small else self.sources, "source_no")


def place_of(seed: int, doc_id: Column, text: Column) -> Column:
    """A row's place in the shuffled order of its source."""
    return F.xxhash64(F.lit(seed), doc_id, text)


def cyclic_weight(ordinal: Column) -> Column:
    """Weights 1, 2, 3, repeating over the sources in order."""
    return (F.pmod(ordinal - 1, F.lit(3)) + 1).cast("double")


def source_targets(sized: DataFrame, *, max_repeats: int, weight=cyclic_weight) -> DataFrame:
    """Targets that share the sum of all sizes by weight; none is above max_repeats times its source's size.

    What is over a limit goes to the others by weight until none is above, which is the level `share` at which
    sum(least(limit, share * weight)) is the total: sources reach their limits in the order of limit / weight.
    One row per source is ordered in a single task; no document passes there.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_documents"))
    per = per.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", weight(F.col("source_no"))).withColumn("limit", max_repeats * F.col("source_size"))
    per = per.withColumn("reached", F.col("limit") / F.col("weight"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("reached", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / open_weight)
    target = F.least(F.col("limit").cast("double"), F.max("level").over(everything) * F.col("weight"))
    return per.withColumn("target", target).withColumn("goal", F.least(F.round("target").cast("long"), F.col("limit"))).drop("limit", "reached", "level")


def plan_mix(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", block_tokens: int = 4096, max_repeats: int = 3, seed: int = 17, weight=cyclic_weight) -> Mix:
    """The schedule that brings each source to its target."""
    spark = docs.sparkSession
    sized = cut(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
            place_of(seed, F.col(doc_id), F.col(text)).alias("place"),
        )
    )
    size, blocks = F.col("source_size"), F.ceil(F.col("source_size") / block_tokens).cast("long")
    sources = source_targets(sized, max_repeats=max_repeats, weight=weight).withColumn("n_blocks", blocks)
    rounds = F.when(size > 0, F.expr("goal div source_size")).otherwise(0)
    sources = sources.withColumn("n_slots", (rounds * F.col("n_blocks") + F.ceil((F.col("goal") - rounds * size) / block_tokens)).cast("long"))
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    sources = cut(sources.withColumn("slots_to", F.sum("n_slots").over(upto)))
    n_sources, n_slots = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_slots"), F.lit(0))).first()
    small = n_sources <= BROADCAST_SOURCES
    names = sources.select("source", "source_no")
    placed = sized.join(F.broadcast(names) if small else names, sized["source"].eqNullSafe(names["source"])).select("doc_id", "source_no", "size", "place")
    placed = running_start(placed.withColumn("segment", F.shiftright("place", 52)), "source_no", "segment", ["place", "doc_id"], F.col("size"), "start")

    points = spark.range(n_slots).select(F.col("id").alias("slot"), F.expr(f"(id + 0.5D) * {GOLDEN}D % 1.0D").alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS))
    total = F.lit(max(n_slots, 1))
    stretch = sources.filter("n_slots > 0").select("source_no", ((F.col("slots_to") - F.col("n_slots")) / total).alias("low"), (F.col("slots_to") / total).alias("high"))
    stretch = stretch.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    drawn = points.join(stretch, "cell").filter("point >= low and point < high").select("slot", "source_no", F.expr("slot div 8192").alias("segment"))
    ranked = running_start(drawn, "source_no", "segment", ["slot"], F.lit(1), "rank").select("slot", "source_no", "rank")
    # The pace is even, not exact: what a source has drawn beyond its slots goes, what it still lacks closes the schedule.
    had = drawn.groupBy("source_no").agg(F.count(F.lit(1)).alias("had"))
    lacking = sources.join(had, "source_no", "left").select("source_no", "n_slots", F.coalesce("had", F.lit(0)).alias("had")).filter("had < n_slots")
    closing = lacking.select("source_no", F.explode(F.sequence("had", F.col("n_slots") - 1)).alias("rank")).select((F.lit(n_slots) + F.col("rank")).alias("slot"), "source_no", "rank")
    mix = Mix(placed, sources, ranked.unionByName(closing), block_tokens, small)
    slots = mix.with_sources(mix.slots).filter("rank < n_slots")
    slots = slots.withColumn("epoch", F.expr("rank div n_blocks")).withColumn("block", F.expr("rank % n_blocks"))
    first = F.col("block") * block_tokens
    tokens = F.least(F.lit(block_tokens), size - first, F.col("goal") - F.col("epoch") * size - first)
    mix.slots = slots.select("slot", "source", "source_no", "epoch", "block", tokens.cast("long").alias("tokens")).filter("tokens > 0")
    return mix


def document_shares(mix: Mix) -> DataFrame:
    """A row per document: size, source_size, target, `taken` words and `passes`, the times the mix reads its first word."""
    b = mix.block_tokens
    # A block is read whole or, in the last rounds, up to a length: a few times, as a source is repeated a few times.
    uses = mix.slots.groupBy("source_no", "block").agg(F.collect_list("tokens").alias("reads"))
    docs = mix.documents.drop("segment")
    worded = docs.filter("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))))
    wordless = docs.filter("size = 0").withColumn("block", F.expr(f"start div {b}"))
    words = F.expr(f"aggregate(coalesce(reads, array()), 0L, (sum, n) -> sum + greatest(0L, least(start + size, block * {b} + n) - greatest(start, block * {b})))")
    passes = F.expr(f"size(filter(coalesce(reads, array()), n -> start >= block * {b} and start < block * {b} + n))").cast("long")
    joined = worded.join(uses, ["source_no", "block"], "left").select("doc_id", "place", "source_no", "start", "size", words.alias("taken"), passes.alias("passes"))
    # Rows with words have a start of their own; each of the others is in one block, so there is nothing to sum.
    summed = joined.groupBy("doc_id", "place", "source_no", "start", "size").agg(F.sum("taken").alias("taken"), F.sum("passes").alias("passes"))
    empty = wordless.join(uses, ["source_no", "block"], "left").select("doc_id", "place", "source_no", "start", "size", F.lit(0).cast("long").alias("taken"), passes.alias("passes"))
    return mix.with_sources(summed.unionByName(empty)).select("doc_id", "size", "source_size", "target", "taken", "passes", "source", "place")


def mix_documents(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", seed: int = 17, **options) -> DataFrame:
    """`docs` with each row repeated as often as the mix reads its first word, which may be not at all; the columns stay."""
    names = docs.columns
    mix = plan_mix(docs, text=text, doc_id=doc_id, seed=seed, **options)
    rows = document_shares(mix).groupBy("doc_id", "place", "source").agg(F.sum("passes").alias("__passes"), F.count(F.lit(1)).alias("__rows"))
    rows = rows.select(F.col("doc_id").alias("__id"), F.col("place").alias("__place"), F.col("source").alias("__source"), "__passes", "__rows")
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (place_of(seed, F.col(doc_id), F.col(text)) == F.col("__place")) & F.col(options.get("source", "source")).eqNullSafe(F.col("__source"))
    # Rows of the same id, text and source share their reads evenly, rounded up.
    times = F.ceil(F.col("__passes") / F.col("__rows")).cast("int")
    held = docs.join(rows, same).withColumn("__times", times).filter("__times > 0")
    return held.withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*names)
