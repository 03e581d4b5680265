"""What several corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import remember as remember
from ..operators.ordered import scope as scope
from ..operators.ordered import shared_folder as shared_folder
from ..operators.ordered import written as cut

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words in a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    """Rows that a model may learn from: a known id that is not held out."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def stored(df: DataFrame) -> DataFrame:
    """As `cut`, in columns and compressed: for tables that are large and read in parts."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    remember(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def text_tags(text: str) -> list[Column]:
    """Two hashes that tell texts apart; null is a text of its own."""
    return [F.xxhash64(text).alias("tag"), F.xxhash64(F.lit(7), text).alias("tag2")]


def if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """`df` marked to be broadcast if it is counted to have that many rows at most, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def running_start(df: DataFrame, key: str, segment: str, order: list[str], value: Column, out: str) -> DataFrame:
    """`out`: sum of `value` over the rows of the same key that come before, by (segment, order).

    No task sees a whole key: rows are summed by (key, segment), the segment totals are run over per key,
    and only the rows of one segment are ordered together. `segment` must follow `order`; `key` holds no nulls.
    """
    part, before, inside = f"{out}__part", f"{out}__before", f"{out}__inside"
    totals = df.groupBy(key, segment).agg(F.sum(value).alias(part))
    earlier = Window.partitionBy(key).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(key, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, segment, F.coalesce(F.sum(part).over(earlier), F.lit(0)).alias(before))
    return (
        df.join(offsets, [key, segment])
        .withColumn(inside, F.coalesce(F.sum(value).over(within), F.lit(0)))
        .withColumn(out, (F.col(before) + F.col(inside)).cast("long"))
        .drop(before, inside)
    )


#: Tables of strata up to this many rows are broadcast; larger ones are joined by key.
BROADCAST_STRATA = 10_000


def smallest_hashes(df: DataFrame, stratum: str, key: str, n: int, total: int | None = None) -> DataFrame:
    """One row for each of the n keys of each stratum with the smallest hash, or of all its keys if they are fewer.

    n shrinks where the strata are so many that all together would have more than `total` rows.

    Of the rows that share a key the least one is taken; null strata are left out. Hashes are evenly spread, so the rows
    of a stratum tell below which hash its n smallest should lie; rows above that are dropped where they are read. Where
    rows share keys, that may leave fewer than n, and the hash is raised until it leaves enough or all.
    """
    rest = [c for c in df.columns if c not in (stratum, key)]
    place = F.xxhash64(key) / F.lit(2.0**64) + 0.5
    counts = cut(df.filter(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count(F.lit(1)).alias("__rows")))
    strata = counts.count()
    n = n if total is None else max(1, min(n, total // max(strata, 1)))
    cuts, small = counts.select(stratum, ((1.25 * n + 256) / F.col("__rows")).alias("__below")), strata <= BROADCAST_STRATA
    while True:
        near = df.join(F.broadcast(cuts) if small else cuts, stratum).filter(place <= F.col("__below"))
        near = cut(near.groupBy(stratum, key).agg(F.min(F.struct(F.xxhash64(*rest), *rest) if rest else F.lit(0)).alias("__row")))
        had = near.groupBy(stratum).agg(F.count(F.lit(1)).alias("__had"))
        wider = cuts.join(had, stratum, "left").withColumn("__short", (F.coalesce("__had", F.lit(0)) < n) & (F.col("__below") < 1))
        if not wider.agg(F.coalesce(F.max("__short"), F.lit(False))).first()[0]:
            break
        cuts = cut(wider.select(stratum, F.when(F.col("__short"), F.col("__below") * 8).otherwise(F.col("__below")).alias("__below")))
    first = Window.partitionBy(stratum).orderBy(F.xxhash64(key), key)
    ranked = near.withColumn("__rank", F.row_number().over(first)).filter(F.col("__rank") <= n)
    return ranked.select(stratum, key, *[F.col("__row")[c].alias(c) for c in rest])
