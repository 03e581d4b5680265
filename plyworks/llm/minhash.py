"""Near copies by b-bit min-hash signatures.

Every distinct shingle set gets `bands * rows` minima of seeded hashes. Bands of whole minima bring candidates together;
of each minimum only the lowest `bits` bits are retained, packed into 64-bit words. Sets that share a band are compared by
their packed words: exclusive or, bits of a slot folded together, a count of bits. Slots of different minima agree by
chance with 2 ** -bits, so the similarity is estimated as (share of equal slots - 2 ** -bits) / (1 - 2 ** -bits). What an
estimate does not rule out (`deviations` standard deviations below the similarity asked for) is a candidate, and links
between candidates are confirmed on the full sets (`similar.verified_roots`).

Sets that many documents have are one row before any band is formed. A band's sets stream through a task that lets single
ones go; of a band with over `max_group` sets all are candidates of one another, by links to the first of them, and in
smaller ones a task compares the packed signatures. No list of pairs is made of a band, only a spanning forest of it.

Defined results: A-Z are lower-cased, words are runs of anything but ASCII white space; fewer words than a shingle are one
shingle; a null text and one without words have an empty set, which is linked with nothing; rows that repeat an id are
told apart by their sets; a null id links like any other but takes no part in "smallest" (a group without any id has a
null component); a very long text counts whole; an empty table gives an empty result; other columns are ignored.
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
from .similar import LINK, MAX_BYTES, MAX_TEXTS, salts, set_column, shingles, verified_roots, with_roots

NO_ID = -(2**63)
_SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("tag", T.LongType()), T.StructField("tag2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("packed", T.BinaryType())])


def minima(hashes: np.ndarray, n: int) -> np.ndarray:
    """The least of each of n seeded 32-bit hashes over a set."""
    flip, times = salts(n)
    low, least = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32), np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        mixed = (low[at : at + 2048, None] ^ flip) * times
        np.minimum(least, (mixed ^ (mixed >> np.uint32(15))).min(axis=0), out=least)
    return least


def pack(least: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bits of each minimum, 64 // bits slots a word; slots that fill up the last word are zero."""
    per = 64 // bits
    slots = np.zeros(-(-len(least) // per) * per, np.uint64)
    slots[: len(least)] = least & np.uint32((1 << bits) - 1)
    return (slots.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(bits))).sum(axis=1, dtype=np.uint64)


@lru_cache
def _slot_mask(bits: int) -> int:
    return sum(1 << (k * bits) for k in range(64 // bits))


def unequal_slots(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """In how many slots packed signatures (words along the last axis) differ."""
    apart = a ^ b
    folded = apart.copy()
    for k in range(1, bits):
        folded |= apart >> np.uint64(k)
    return np.bitwise_count(folded & np.uint64(_slot_mask(bits))).sum(axis=-1, dtype=np.int64)


def estimate(unequal, n: int, bits: int):
    """Similarity of sets of which `unequal` of n slots differ, corrected for slots that agree by chance."""
    chance = 2.0**-bits
    return ((n - unequal) / n - chance) / (1 - chance)


def most_unequal(least: float, n: int, bits: int, deviations: float) -> int:
    """Slots that may differ so that the estimate lies at most so many standard deviations below `least`."""
    chance = 2.0**-bits
    equal = chance + (1 - chance) * least
    return int(np.floor(n * (1 - equal) + deviations * np.sqrt(n * equal * (1 - equal))))


def sketch_of(text: str | None, width: int, bands: int, rows: int, bits: int) -> dict:
    """Size of a text's set, two hashes of it, a key for each band, and the packed signature."""
    own = shingles(text, width)
    raw = own.tobytes()
    tags = np.array([xxhash.xxh64_intdigest(raw, k) for k in (1, 2)], np.uint64).view(np.int64)
    if not len(own):
        return {"n": 0, "tag": tags[0], "tag2": tags[1], "bands": None, "packed": None}
    least = minima(own, bands * rows)
    keys = np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(bands, rows))], np.uint64).view(np.int64)
    return {"n": len(own), "tag": tags[0], "tag2": tags[1], "bands": keys, "packed": pack(least, bits).tobytes()}


def shared_bands(max_group: int):
    """Rows (lead, node) sorted by lead: those that share a lead, and of a lead with over `max_group` nodes links to its first one."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, first, n = None, None, 0  # of the lead that is open, and what of it is held
        held: list[np.ndarray] = []

        def closed():
            nodes = np.concatenate(held) if held and n > 1 and n <= max_group else np.zeros(0, np.int64)
            return [(np.full(len(nodes), lead), nodes, np.full(len(nodes), -1))] if len(nodes) else []

        for batch in batches:
            if not batch.num_rows:
                continue
            leads, nodes = (np.asarray(batch.column(k)) for k in (0, 1))
            starts = np.flatnonzero(np.append(True, leads[1:] != leads[:-1]))
            ends = np.append(starts[1:], len(leads))
            out = []
            whole = (np.arange(len(starts)) > 0) & (np.arange(len(starts)) < len(starts) - 1) & (ends - starts > 1) & (ends - starts <= max_group)
            rows = np.repeat(whole, ends - starts)  # groups that lie inside this batch
            if rows.any():
                out.append((leads[rows], nodes[rows], np.full(rows.sum(), -1)))
            for k in np.flatnonzero(~whole & ((ends - starts > max_group) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1))):
                a, b = starts[k], ends[k]
                if lead is None or leads[a] != lead:
                    out += closed() if lead is not None else []
                    lead, first, n, held = leads[a], nodes[a], 0, []
                n, part = n + b - a, nodes[a:b]
                if n > max_group:
                    part = np.concatenate([*held, part])
                    out.append((np.full(len(part), lead), part, np.full(len(part), first)))
                    held = []
                else:
                    held.append(part)
            yield _rows(out)
        yield _rows(closed() if lead is not None else [])

    def _rows(parts) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
        arrays = [pa.array(c.astype(np.int64)) for c in columns]
        return pa.RecordBatch.from_arrays([*arrays[:2], pa.array(columns[2].astype(np.int64), mask=columns[2] < 0)], names=["lead", "node", "hub"])

    return stream


def alike_forest(words: np.ndarray, bits: int, most: int) -> list[tuple[int, int]]:
    """Links that connect all rows whose packed signatures differ in at most `most` slots, directly or over others.

    As in `similar.verified_links`: after some rows only those outside the main group are compared with all."""
    n, label, out, main = len(words), np.arange(len(words)), [], None
    for i in range(n):
        if i == min(8, n - 1):
            names, count = np.unique(label, return_counts=True)
            main = names[count.argmax()]
        if main is not None and label[i] == main:
            continue
        near = np.flatnonzero(unequal_slots(words, words[i], bits) <= most)
        for other, at in zip(*np.unique(label[near], return_index=True)):
            if other != label[i]:
                out.append((i, int(near[at])))
                low, high = (main, label[i]) if other == main else (label[i], other)
                label[label == high] = low
    return out


def _candidates(bits: int, most: int):
    """Rows (lead, node, packed) sorted by lead: links inside each lead."""

    def links(nodes: list, packed: list) -> list[tuple[int, int]]:
        words = np.stack([np.frombuffer(p, np.uint64) for p in packed])
        return [(nodes[i], nodes[j]) for i, j in alike_forest(words, bits, most)]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, nodes, packed = None, [], []
        for batch in batches:
            found = []
            for key, node, p in zip(*(c.to_pylist() for c in batch.columns)):
                if key != lead:
                    found += links(nodes, packed) if len(nodes) > 1 else []
                    lead, nodes, packed = key, [], []
                nodes.append(node)
                packed.append(p)
            yield _pairs(found)
        yield _pairs(links(nodes, packed) if len(nodes) > 1 else [])

    def _pairs(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return stream


def near_sets(
    docs: DataFrame, *, width: int = 5, least: float = 0.8, bands: int = 40, rows: int = 5, bits: int = 2, deviations: float = 5.0, max_group: int = 4096,
    max_texts: int = MAX_TEXTS, max_bytes: int = MAX_BYTES, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the smallest id reachable over sets with a Jaccard similarity of `least`) and kept.

    Two sets of similarity s share a band with chance 1 - (1 - s ** rows) ** bands: 0.9999999 at 0.8. A document without an
    id is kept if no document with one is in its group."""

    @F.pandas_udf(_SKETCH)
    def sketch(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketch_of(t, width, bands, rows, bits) for t in values], columns=_SKETCH.names)

    tags = ["tag", "tag2"]
    own = F.struct(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"))
    prints = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), own.alias("own"), sketch(F.col(text)).alias("s")).select("doc_id", "own", "s.*"))
    classes = prints.filter("n > 0").groupBy(*tags).agg(F.min("doc_id").alias("least"), F.min("own").alias("own"), F.first(F.struct("bands", "packed")).alias("s"))
    classes = cut(classes.select("*", F.monotonically_increasing_id().alias("node")))  # written, so that a set keeps its number
    keyed = classes.select(F.explode("s.bands").alias("lead"), "node")
    shared = cut(keyed.repartition("lead").sortWithinPartitions("lead").mapInArrow(shared_bands(max_group), "lead long, node long, hub long"))
    signed = shared.filter("hub is null").join(classes.select("node", "s.packed"), "node").select("lead", "node", "packed")
    links = signed.repartition("lead").sortWithinPartitions("lead").mapInArrow(_candidates(bits, most_unequal(least, bands * rows, bits, deviations)), LINK)
    links = links.unionByName(shared.filter("hub is not null").select(F.col("node").alias("u"), F.col("hub").alias("v")))
    found = cut(with_roots(components(links)))
    read = found.join(classes.select("node", "own"), "node").join(docs.select(own.alias("own"), F.col(text).alias("text")), "own")
    held = cut(read.dropDuplicates(["node"]).select("node", "root", set_column(F.col("text"), width).alias("set")))
    roots = verified_roots(held, shared.select("node", "lead"), least, max_texts=max_texts, max_bytes=max_bytes)
    rooted = classes.join(roots, "node", "left").select(*tags, "least", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    merged = rooted.join(smallest, "root").select(*tags, "component")
    empty = prints.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    filled = prints.filter("n > 0").join(merged, tags).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return filled.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

