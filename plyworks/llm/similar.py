"""Links between texts whose shingle sets are alike, checked on the whole sets.

Operators that look for near copies bring candidates in their own way; what candidates connect is a candidate set. Here
links are checked inside each candidate set on the shingles themselves, all pairs counting. A set that is small in texts
and in bytes is checked inside one task. In a larger one all texts are compared with one leader, and what this leaves
apart is checked with all texts of its bands, in blocks that are bounded in texts and in bytes; so a task holds two blocks
at most, however long the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .graph import components

LINK = "u long, v long"
#: Texts, and bytes of their sets, that a task checks against each other.
MAX_TEXTS, MAX_BYTES = 2000, 1 << 24


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of a text's shingles, repeats included; fewer words than `width` are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII white space and A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    spans = zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist())
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64, n)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text, width))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; two empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


@lru_cache
def salts(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 32, (2, n), np.uint32) | np.array([[0], [1]], np.uint32)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of `rows` min-hashes. Two texts of similarity s share one with chance s ** rows."""
    flip, times = salts(bands * rows)
    low, least = hashes.astype(np.uint32), np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(least, ((low[at : at + 2048, None] ^ flip) * times).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(bands, rows))], np.uint64).view(np.int64)


def verified_links(sets: list[np.ndarray], label: np.ndarray, least: float, first: int = 8) -> list[tuple[int, int]]:
    """Links that join all rows whose shingle sets have a Jaccard similarity of `least`; rows of equal label count as joined.

    Some rows are compared with all others; the label that then has most rows is the main one. Of two rows that still
    have to be joined one at least has another label, so comparing only the rows of other labels leaves nothing out."""
    n, label = len(sets), label.copy()
    size = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=1))])
    holders = np.repeat(np.arange(n), size)[np.argsort(code, kind="stable")]
    start = np.concatenate([[0], np.cumsum(size)])
    main, out = None, []
    first = first if len(np.unique(label)) == n else 0
    for i in range(n):
        if i == first:
            names, rows = np.unique(label, return_counts=True)
            main = names[rows.argmax()]
        if i >= first and label[i] == main:
            continue
        own = code[start[i] : start[i + 1]]
        a, many = begin[own], begin[own + 1] - begin[own]
        both = np.bincount(holders[np.arange(many.sum()) + np.repeat(a - (np.cumsum(many) - many), many)], minlength=n)
        union = size + size[i] - both
        near = np.flatnonzero(np.where(union > 0, both / np.maximum(union, 1), 1.0) >= least)
        before = label[i]
        for other, at in zip(*np.unique(label[near], return_index=True)):
            if other != before:
                out.append((i, int(near[at])))
                low, high = (main, other) if label[i] == main else (other, label[i])
                label[label == high] = low
    return out


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _verify(least: float):
    """Rows sorted by group (key, a, b) with node, label and set: verified links inside each group."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        return [(rows[i][3], rows[j][3]) for i, j in verified_links(sets, np.array([r[4] for r in rows]), least)]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    found += links(held)
                    held = []
                held.append(row)
            yield _pairs(found)
        yield _pairs(links(held))

    return stream


def _verified(rows: DataFrame, least: float) -> DataFrame:
    """Verified links of rows (key, a, b, node, label, set) inside each (key, a, b)."""
    group = ["key", "a", "b"]
    return rows.select(*group, "node", "label", "set").repartition(*group).sortWithinPartitions(*group).mapInArrow(_verify(least), LINK)


def set_column(text, width: int):
    """The distinct shingle hashes of a text, sorted, as bytes."""

    @F.pandas_udf(T.BinaryType())
    def sets(values: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width).tobytes() for t in values], dtype=object)

    return sets(text)


def verified_roots(held: DataFrame, bands: DataFrame, least: float, *, max_texts: int = MAX_TEXTS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(node, root): what links of a Jaccard similarity of `least` connect, for every node but the roots.

    held: a row per text, with node, root (its candidate set) and set (sorted shingle hashes as bytes); it should be a
    written table. bands: (node, lead), the bands that candidates came from; texts of one candidate set that share no
    band are linked over others or not at all."""

    @F.pandas_udf(T.BooleanType())
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(a, b)], dtype=bool)

    weight = F.octet_length("set").cast("long")
    sizes = held.groupBy("root").agg(F.count(F.lit(1)).alias("texts"), F.sum(weight).alias("bytes"), F.min("node").alias("leader"))
    sizes = sizes.filter("texts > 1").withColumn("whole", (F.col("texts") <= max_texts) & (F.col("bytes") <= max_bytes))
    sized = held.join(sizes, "root")
    zero = F.lit(0).cast("long").alias
    links = _verified(sized.filter("whole").select(F.col("root").alias("key"), zero("a"), zero("b"), "node", F.col("node").alias("label"), "set"), least)
    large = sizes.filter("not whole").select("root", "leader")
    if not large.isEmpty():
        large = held.join(large, "root")
        lead = large.filter("node = leader").select("root", F.col("set").alias("with"))
        judged = cut(large.join(lead, "root").select("node", "leader", weight.alias("bytes"), "set", alike("set", "with").alias("joined")))
        stars = judged.filter("joined and node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v"))
        label = F.when(F.col("joined"), F.col("leader")).otherwise(F.col("node"))
        placed = judged.select("node", "bytes", label.alias("label")).join(bands, "node")
        # Of two texts that still have to be joined one at least is not of the band's main label: only these meet all others.
        labels = placed.groupBy("lead", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).groupBy("lead")
        labels = labels.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "label", "bytes")).alias("main")).filter("n > main.n")
        parts = lambda n, b: F.greatest(F.ceil(n / F.lit(max_texts)), F.ceil(b / F.lit(max_bytes))).cast("long")
        others = parts(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes"))
        placed = placed.join(labels.select("lead", F.col("main.label").alias("main"), parts(F.col("n"), F.col("bytes")).alias("blocks"), others.alias("others")), "lead")
        place, upto = F.xxhash64("node"), lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        among = F.transform(upto("others"), lambda a: pair(a, F.pmod(place, F.col("blocks"))))
        asks = F.transform(upto("blocks"), lambda b: pair(F.pmod(place, F.col("others")), b))
        placed = placed.withColumn("at", F.explode(F.when(F.col("label") == F.col("main"), among).otherwise(F.array_union(among, asks))))
        placed = placed.select(F.col("lead").alias("key"), "at.a", "at.b", "node", "label")
        rest = _verified(placed.join(judged.select("node", "set"), "node"), least)
        links = links.unionByName(stars).unionByName(rest)
    return components(links)


def with_roots(found: DataFrame) -> DataFrame:
    """(node, root) of `components`, with the roots themselves."""
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
