"""Line dedup: range-partitioned line hashes, sorted by document and position, streamed for first occurrences.

Lines are compared by a key (ends stripped of ASCII white space, A-Z lower-cased), hashed to 128 bits. The hashes are
partitioned by range together with document and position, so a line that a third of all documents hold is spread over
many partitions. One streaming pass over each sorted partition settles every key that begins there; what lies at the
edges of partitions (two keys a partition at most) is settled by a join with a table of that bounded size. The result
is a compressed keep bitmap per document, no text.

Defined results: a null or empty text is one empty line; a null id sorts before every other and equals only null ids;
rows that repeat an id are one document, each row with its own bitmap; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, ascii_lower, cut, if_small

NO_ID = -(2**63)
_MARKS = "doc long, tag long, pos int, h1 long, h2 long, open boolean"


def stripped(line):
    return F.trim(line, F.lit(WHITE))


def _rows(columns, open_: bool) -> pa.RecordBatch:
    """A batch of the columns doc, tag, pos, h1, h2."""
    arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(columns[0]), open_))], names=["doc", "tag", "pos", "h1", "h2", "open"])


def _first_occurrences(min_docs: int):
    """Stream lines sorted by key, document (largest first) and position; give what to drop, and what is still open."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_key = None  # the partition's first key may have begun in an earlier partition
        rest = None  # rows of a last key with too few documents so far
        settled = None  # a last key that has enough documents: (h1, h2, its first documents)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [np.asarray(batch.column(n)) for n in ("doc", "tag", "pos", "h1", "h2")]
            if rest is not None:
                new = [np.concatenate(x) for x in zip(rest, new)]
                rest = None
            doc, tag, pos, h1, h2 = new
            if first_key is None:
                first_key = (h1[0], h2[0])
            lead = (h1 == first_key[0]) & (h2 == first_key[1])
            if lead.any():
                yield _rows([x[lead] for x in new], True)
                if lead.all():
                    continue
                doc, tag, pos, h1, h2 = new = [x[~lead] for x in new]
            n = len(doc)
            group = np.ones(n, bool)
            group[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            goes_on = settled is not None and (h1[0], h2[0]) == settled[:2]
            fresh = group.copy()
            fresh[1:] |= doc[1:] != doc[:-1]
            starts = np.flatnonzero(group)
            count = np.cumsum(fresh)
            nth = count - np.repeat(count[starts] - 1, np.diff(np.append(starts, n)))  # 1 for the rows of a key's largest document
            docs = np.maximum.reduceat(nth, starts)
            if goes_on:  # all of it lies behind the largest document
                nth[: starts[1] if len(starts) > 1 else n] += min_docs
                docs[0] += min_docs
            last = slice(starts[-1], n)
            enough = np.repeat(docs >= min_docs, np.diff(np.append(starts, n)))
            out = enough & (nth > 1)
            if out.any():
                yield _rows([x[out] for x in new], False)
            if docs[-1] < min_docs:
                rest, settled = [x[last] for x in new], None
            elif not (goes_on and len(starts) == 1):
                settled = (h1[-1], h2[-1], doc[last][fresh[last]][:min_docs])
        if rest is not None:
            yield _rows(rest, True)
        if settled is not None:  # witnesses, for the rows of this key in the next partition
            k = len(settled[2])
            yield _rows([settled[2], np.zeros(k, int), np.full(k, -1), np.full(k, settled[0]), np.full(k, settled[1])], True)

    return stream


def dropped_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, tag, pos) of each line to drop; tag is the text's hash, doc the id (NO_ID for null)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(whole).alias("tag"), F.posexplode(F.split(whole, "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc", "tag", "pos", stripped(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    keyed = keyed.withColumn("key", ascii_lower(F.col("key")))  # which changes no length
    hashed = keyed.select("doc", "tag", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    hashed = cut(hashed)  # finding the ranges reads all rows once more: these, not the texts
    order = ["h1", "h2", F.col("doc").desc(), "pos"]
    marks = cut(hashed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_first_occurrences(min_docs), _MARKS))
    edges = marks.filter("open")
    facts = edges.groupBy("h1", "h2").agg(F.max("doc").alias("largest"), F.countDistinct("doc").alias("docs")).filter(F.col("docs") >= min_docs)
    late = edges.join(if_small(facts), ["h1", "h2"]).filter("doc < largest and pos >= 0")
    return marks.filter("not open").select("doc", "tag", "pos").unionByName(late.select("doc", "tag", "pos"))


@F.pandas_udf(T.BinaryType())
def _bitmap(drops: pd.Series) -> pd.Series:
    def one(gone):
        keep = np.ones(-(-(max(gone) + 1) // 8) * 8, np.uint8)  # whole bytes: what fills up the last one stays, too
        keep[gone] = 0
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([one(d) for d in drops], dtype=object)


def keep_bitmaps(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """Per document with lines to drop: doc, tag, n_dropped and the zlib-compressed bitmap of the lines kept, first line first.

    A bitmap ends with the last line that goes; all lines after it stay."""
    drops = dropped_lines(docs, text=text, doc_id=doc_id, **options).groupBy("doc", "tag").agg(F.collect_set("pos").alias("drops"))
    return drops.select("doc", "tag", F.size("drops").cast("long").alias("n_dropped"), _bitmap("drops").alias("keep"))


def line_count(text):
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


@F.pandas_udf(T.StringType())
def _kept_text(text: pd.Series, keep: pd.Series) -> pd.Series:
    def one(t, bits):
        if bits is None:
            return t
        flags = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))
        lines = t.split("\n", len(flags))
        return "\n".join([line for k, line in enumerate(lines) if k >= len(flags) or flags[k]])

    return pd.Series([one(t, b) for t, b in zip(text, keep)], dtype=object)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` with its lines kept in `text` (a null text that loses nothing stays null) and __n_lines, __n_dropped added."""
    whole = F.coalesce(F.col(text), F.lit(""))
    maps = bitmaps.select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.col("n_dropped").alias("__gone"), F.col("keep").alias("__keep"))
    match = (F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)) == F.col("__doc")) & (F.xxhash64(whole) == F.col("__tag"))
    joined = docs.join(maps, match, "left").withColumn("__n_lines", line_count(whole))
    joined = joined.withColumn("__n_dropped", F.coalesce("__gone", F.lit(0)).cast("long"))
    kept = F.when(F.col("__keep").isNull(), F.col(text)).otherwise(_kept_text(F.when(F.col("__keep").isNotNull(), F.col(text)), "__keep"))
    return joined.withColumn(text, kept).drop("__doc", "__tag", "__gone", "__keep")
