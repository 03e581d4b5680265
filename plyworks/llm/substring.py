"""Substring dedup by hashing units of text.

A text is cut after line ends and after sentence ends; the pieces, normalised (lower case, single spaces), are hashed
to 128 bits. Digests are grouped over all documents; the earliest occurrence by (doc_id, offset) stays, later ones are
repeats. A run of neighbouring repeats goes if it has `min_words` words, so a passage goes with the short sentences in
it, while a short sentence that happens to recur stays. Removed spans keep their offsets in the original text.

Defined results: a null or empty text has no units; a null id sorts before every other; rows that repeat an id and a
text are one document, rows that repeat an id with other texts are ordered by the text's hash; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

_UNIT = re.compile(r"[^\n.!?]*(?:[.!?](?![\s])[^\n.!?]*)*(?:[.!?]+[^\S\n]*|\n+|$)\n*")
_UNITS = "doc long, tag long, unit int, first int, last int, words int, h1 long, h2 long"
NO_ID = -(2**63)


def _id(name: str):
    return F.when(F.col(name) != NO_ID, F.col(name))


def units(text: str) -> list[tuple[int, int]]:
    """Spans that cover the text, each ending with a line or a sentence."""
    return [m.span() for m in _UNIT.finditer(text) if m.end() > m.start()]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        rows: list[tuple] = []
        hashes: list[bytes] = []

        def flush():
            nonlocal rows, hashes
            cols = list(zip(*rows))
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)] + [pa.array(h[:, 0]), pa.array(h[:, 1])]
            rows, hashes = [], []
            return pa.RecordBatch.from_arrays(arrays, names=["doc", "tag", "unit", "first", "last", "words", "h1", "h2"])

        for doc, tag, text in zip(*(batch.column(n).to_pylist() for n in ("doc", "tag", "text"))):
            k = 0
            for a, b in units(text):
                found = text[a:b].lower().split()
                if found:
                    rows.append((doc, tag, k, a, b, len(found)))
                    hashes.append(digest(" ".join(found).encode("utf-8", "surrogatepass")))
                    k += 1
            if len(rows) > 50_000:
                yield flush()
        if rows:
            yield flush()


def repeated_spans(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_words: int = 10) -> DataFrame:
    """A row per span to remove: doc, tag (the text's hash), first and last offset (code points, end exclusive), units, words, keeper.

    `min_words` is the least length of a span, so of a run of repeats; 1 gives every repeated unit."""
    source = docs.filter(F.col(text).isNotNull()).select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.col(text)).alias("tag"), F.col(text).alias("text"))
    cut_up = stored(source.mapInArrow(_digests, _UNITS))  # texts are cut and hashed once
    place = F.struct("doc", "tag", "unit")
    kept = cut_up.groupBy("h1", "h2").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("places")).filter("places > 1").drop("places")
    kept = stored(kept)  # read anew, it joins as a plain shuffle, of which Spark can split what a common unit makes large
    repeats = cut_up.join(kept, ["h1", "h2"]).filter(place != F.col("earliest")).select("doc", "tag", "unit", "first", "last", "words", F.col("earliest.doc").alias("keeper")).distinct()
    run = F.col("unit") - F.row_number().over(Window.partitionBy("doc", "tag").orderBy("unit"))
    spans = repeats.withColumn("run", run).groupBy("doc", "tag", "run")
    spans = spans.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("units"), F.sum("words").alias("words"), F.min_by("keeper", "unit").alias("keeper"))
    return spans.filter(F.col("words") >= min_words).drop("run").select(_id("doc").alias("doc"), "tag", "first", "last", "units", "words", _id("keeper").alias("keeper"))


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, spans: pd.Series) -> pd.Series:
    def one(t, gone):
        out, at = [], 0
        for s in sorted(gone, key=lambda s: s["first"]):
            out.append(t[at : s["first"]])
            at = s["last"]
        return "".join([*out, t[at:]])

    return pd.Series([t if t is None or s is None else one(t, s) for t, s in zip(text, spans)], dtype=object)


def remove_spans(docs: DataFrame, spans: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` without the spans; nothing else of a text changes."""
    per = spans.groupBy(F.coalesce("doc", F.lit(NO_ID)).alias("doc"), "tag").agg(F.collect_list(F.struct("first", "last")).alias("__spans")).withColumnsRenamed({"doc": "__doc", "tag": "__tag"})
    match = (F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)) == F.col("__doc")) & (F.xxhash64(F.col(text)) == F.col("__tag"))
    return docs.join(per, match, "left").withColumn(text, _without(F.col(text), "__spans")).drop("__doc", "__tag", "__spans")
