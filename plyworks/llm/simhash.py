"""SimHash near-duplicates by a binary trie self-join.

Fingerprints of equal bits are one class. Two classes within the bit budget agree wholly in one of budget + 1 blocks
of bits; so each class enters one trie per block, turned so that this block leads, and the root of every subtrie is a
pair of one node with itself. Node pairs are then followed down together, adding up the bits in which they differ, and
dropped as soon as the budget is exceeded. Subtries that are too large for one task are followed down by Spark, some
bits a round, each pair of child nodes becoming a group of its own; the others are followed down inside a task, all
subtries of a slice at once. A task gives a spanning forest of the links it found, and components join the forests.

Defined results: a text without words (or null) has fingerprint zero, which links like any other; fewer words than a
shingle give one shingle; rows that repeat an id are told apart by their fingerprints, which are the nodes of the graph; a null id links
like any other but takes no part in "smallest" (a component without any id is null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, if_small, text_tags
from .graph import components
from .similar import LINK, MAX_BYTES, MAX_TEXTS, band_keys, set_column, shingle_hashes, verified_roots, with_roots
from .similar import shingles as shingles
from .similar import similarity as similarity

BITS = 64
NO_ID = -(2**63)


def bits_of(hashes: np.ndarray) -> int:
    """64 bits as a signed integer: a bit is set if it is in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    return bits_of(shingle_hashes(text, width))


def fingerprint_column(text, width: int = 3):
    @F.pandas_udf(T.LongType())
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return prints(text)


class _Forest:
    """Labels of the rows of a slice; linked rows get the smallest label."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.changed()

    def changed(self) -> None:
        ends = np.append(np.flatnonzero(np.diff(self.label)), len(self.label) - 1)
        self.run_end = np.repeat(ends + 1, np.diff(np.append(-1, ends)))  # end of the run of equal labels

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low != high
            if not apart.any():
                break
            np.minimum.at(label, high[apart], low[apart])
            while not np.array_equal(up := label[label], label):
                label[:] = up
        self.changed()

    def joined(self, a0, a1, b0, b1) -> np.ndarray:
        """Node pairs whose rows all have one label already."""
        return (self.run_end[a0] >= a1) & (self.run_end[b0] >= b1) & (self.label[a0] == self.label[b0])


def trie_links(values: np.ndarray, pairs: np.ndarray, depth: np.ndarray, budget: int, block: int = 1 << 17) -> np.ndarray:
    """Labels after linking all rows of node pairs that differ in at most `budget` bits.

    values: uint64, sorted inside each node. pairs: columns a0, a1, b0, b1, bits that differ so far; a node is the rows
    a0..a1 of equal leading `depth` bits. Wide frontiers are followed in parts, deepest first, so memory is bounded.
    """
    forest = _Forest(len(values))
    ones: dict[int, np.ndarray] = {}
    stack = [(int(d), pairs[:, depth == d]) for d in np.unique(depth)]
    while stack:
        d, (a0, a1, b0, b1, diff) = stack.pop()
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        i, j = a0[single], b0[single]
        near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
        if near.any():
            forest.link(i[near], j[near])
        more = ~single
        if d >= BITS or not more.any():
            for low, high, to in ((a0, a1, a0), (b0, b1, a0)) if more.any() else ():  # equal values
                many = (high - low)[more]
                rows = np.arange(many.sum()) + np.repeat(low[more] - (np.cumsum(many) - many), many)
                forest.link(rows, np.repeat(to[more], many))
            continue
        a0, a1, b0, b1, diff = (x[more] for x in (a0, a1, b0, b1, diff))
        open_ = ~forest.joined(a0, a1, b0, b1)
        a0, a1, b0, b1, diff = (x[open_] for x in (a0, a1, b0, b1, diff))
        if len(a0) > block:
            half = len(a0) // 2
            stack += [(d, np.stack([x[:half] for x in (a0, a1, b0, b1, diff)])), (d, np.stack([x[half:] for x in (a0, a1, b0, b1, diff)]))]
            continue
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((values >> np.uint64(BITS - 1 - d)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[d][a1] - ones[d][a0]), b1 - (ones[d][b1] - ones[d][b0])
        other = a0 != b0
        children = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1), tuple(x[other] for x in (am, a1, b0, bm, diff + 1))]
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*children))
        good = (a1 > a0) & (b1 > b0) & (diff <= budget) & ((a0 != b0) | (a1 - a0 > 1))
        if good.any():
            stack.append((d + 1, np.stack([x[good] for x in (a0, a1, b0, b1, diff)])))
    return forest.label


def _follow(budget: int, slice_rows: int):
    """Rows sorted by group (turn, pa, pb, depth) and value: links of every group, a slice of whole groups at a time."""

    def links(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        turn, pa_, pb, depth, diff, value, rep = cols
        value = value.view(np.uint64)
        new = np.ones(len(turn), bool)
        new[1:] = (np.diff(turn) != 0) | (np.diff(pa_) != 0) | (np.diff(pb) != 0) | (np.diff(depth) != 0)
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(turn))
        same = pa_[start] == pb[start]
        right = (value >> (np.uint64(BITS) - depth.astype(np.uint64))).view(np.int64) == pb
        mid = end - np.add.reduceat(right.astype(np.int64), start)
        pairs = np.stack([start, np.where(same, end, mid), np.where(same, start, mid), end, diff[start]])
        good = (pairs[1] > pairs[0]) & (pairs[3] > pairs[2]) & (~same | (end - start > 1))
        if not good.any():
            return None
        label = trie_links(value, pairs[:, good], depth[start][good], budget)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[label[moved]])], names=["u", "v"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def flush(last: bool):
            nonlocal held, rows
            cols = [np.concatenate(x) for x in zip(*held)]
            stop = len(cols[0])
            if not last:
                inside = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1]) & (cols[3] == cols[3][-1])
                stop = int(np.flatnonzero(~inside)[-1]) + 1 if not inside.all() else 0
            held = [[c[stop:] for c in cols]]
            rows = len(cols[0]) - stop
            return links([c[:stop] for c in cols]) if stop else None

        for batch in batches:
            if batch.num_rows:
                held.append([np.asarray(c).astype(np.int64) for c in batch.columns])
                rows += batch.num_rows
                if rows >= slice_rows and (out := flush(False)) is not None:
                    yield out
        if rows and (out := flush(True)) is not None:
            yield out

    return stream


def near_links(classes: DataFrame, *, budget: int = 2, led: bool = False, max_group: int = 200_000, step_bits: int = 6) -> DataFrame:
    """edges(u, v) that connect all classes (bits long, rep long) within `budget` differing bits, directly or over others.

    With `led`, only classes of the same `lead` (long) are compared: each lead is the root of a trie of its own. The links then are
    candidates, which the caller checks: a lead that over `max_group` classes have links them all to one, unread."""
    if led:
        keyed = classes.select(F.col("lead").alias("turn"), F.lit(0).cast("long").alias("pa"), F.lit(0).alias("depth"), F.col("bits").alias("value"), "rep")
    else:
        sizes = [BITS // (budget + 1) + (k < BITS % (budget + 1)) for k in range(budget + 1)]
        shifts = [sum(sizes[:k]) for k in range(budget + 1)]
        turns = F.array(*[F.struct(F.lit(k).alias("turn"), F.lit(shifts[k]).alias("shift"), F.lit(sizes[k]).alias("depth")) for k in range(budget + 1)])
        rotated = F.expr("case when shift = 0 then bits else shiftleft(bits, shift) | shiftrightunsigned(bits, 64 - shift) end")
        keyed = classes.select("bits", "rep", F.inline(turns)).withColumn("value", rotated)
        keyed = keyed.withColumn("pa", F.expr("shiftrightunsigned(value, 64 - depth)"))
    keyed = keyed.select("turn", "pa", F.col("pa").alias("pb"), "depth", F.lit(0).alias("diff"), "value", "rep")
    group = ["turn", "pa", "pb", "depth"]
    found = None
    while True:
        large = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > max_group).filter(f"depth + {step_bits} <= {BITS}").drop("rows")
        large = cut(large)
        done = large.isEmpty()
        large = if_small(large)  # there is one such group per max_group rows at most
        small = keyed if done else keyed.join(large, group, "left_anti")
        order = [*group, F.col("value").bitwiseXOR(F.lit(-(2**63)))]  # as unsigned
        part = small.repartition(*group).sortWithinPartitions(*order).select(*group, "diff", "value", "rep").mapInArrow(_follow(budget, 1 << 16), LINK)
        found = part if found is None else found.unionByName(part)
        if led and not done:
            hubs = keyed.join(large, group).groupBy(*group).agg(F.min("rep").alias("v"))
            found, done = found.unionByName(keyed.join(if_small(hubs), group).select(F.col("rep").alias("u"), "v")), True
        if done:
            return found
        masks = [0, *(sum(1 << b for b in c) for k in range(1, budget + 1) for c in combinations(range(step_bits), k))]
        flips = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count()).alias("flipped")) for m in masks])
        hot = keyed.join(large, group).select("*", F.inline(flips)).filter(F.col("diff") + F.col("flipped") <= budget)
        own = F.expr(f"shiftrightunsigned(value, 64 - depth - {step_bits})")
        left = F.expr("shiftrightunsigned(value, 64 - depth)") == F.col("pa")
        with_ = F.shiftleft(F.when(left, F.col("pb")).otherwise(F.col("pa")), step_bits).bitwiseOR((own.bitwiseAND(F.lit((1 << step_bits) - 1))).bitwiseXOR(F.col("mask")))
        inner = F.col("pa") == F.col("pb")
        a = F.when(inner, F.least(own, with_)).when(left, own).otherwise(with_)
        b = F.when(inner, F.greatest(own, with_)).when(left, with_).otherwise(own)
        keyed = cut(hot.select("turn", a.alias("pa"), b.alias("pb"), (F.col("depth") + step_bits).alias("depth"), (F.col("diff") + F.col("flipped")).alias("diff"), "value", "rep"))


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 3, budget: int = 2, **options) -> DataFrame:
    """doc_id, fingerprint (long) and component_id, the smallest doc_id reachable over links of at most `budget` bits; a row per input row."""
    prints = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprint_column(F.col(text), width).alias("bits")))
    classes = cut(prints.groupBy("bits").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(classes.select("bits", F.col("bits").alias("rep")), budget=budget, **options))
    rooted = classes.join(roots, classes["bits"] == roots["node"], "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    merged = rooted.join(smallest, "root").select("bits", "component_id")
    return prints.join(merged, "bits").select("doc_id", F.col("bits").alias("fingerprint"), "component_id")


def near_copies(
    docs: DataFrame, *, width: int = 5, budget: int = 20, least: float = 0.8, bands: int = 20, rows: int = 6, max_texts: int = MAX_TEXTS, max_bytes: int = MAX_BYTES,
    text: str = "text", doc_id: str = "doc_id", **options,
) -> DataFrame:
    """doc_id, tag, tag2 (two hashes of the text) and kept, the smallest doc_id of the group: a row per id and text; null ids have none.

    Texts are linked if their shingles have a Jaccard similarity of `least`; groups are what links connect. Candidates come
    from tries led by bands of min-hashes: texts meet where a band agrees, and their fingerprints are followed down with
    `budget` bits. What that connects is a set of candidates, in which links are checked on the shingles themselves
    (`similar.verified_roots`), at most `max_texts` texts or `max_bytes` of shingles against each other in a task.

    Null and empty texts have no shingles and are alike; very long texts count whole; equal texts (in both hashes) are one,
    with or without ids; an empty table gives an empty result; other columns are ignored."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sketch(values: pd.Series) -> pd.Series:
        hashes = (shingle_hashes(t, width) for t in values)
        return pd.Series([np.append(np.int64(bits_of(h)), band_keys(h, bands, rows)) for h in hashes], dtype=object)

    tags = ["tag", "tag2"]
    prints = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), *text_tags(text), sketch(F.col(text)).alias("sketch")))
    classes = prints.groupBy(*tags).agg(F.min("doc_id").alias("least"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))  # written, so that a text keeps its number
    keyed = classes.select("node", F.element_at("sketch", 1).alias("bits"), F.explode(F.slice("sketch", 2, bands)).alias("lead"))
    found = cut(with_roots(components(near_links(keyed.select("lead", "bits", F.col("node").alias("rep")), budget=budget, led=True, **options))))
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("least"), *text_tags(text), F.col(text).alias("text"))
    wanted = found.join(classes.select("node", *tags, F.coalesce("least", F.lit(NO_ID)).alias("least")), "node")
    held = cut(wanted.join(source, ["least", *tags]).dropDuplicates(["node"]).select("node", "root", set_column(F.col("text"), width).alias("set")))
    roots = verified_roots(held, keyed.select("node", "lead"), least, max_texts=max_texts, max_bytes=max_bytes)
    rooted = classes.join(roots, "node", "left").select(*tags, "least", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("kept"))
    merged = rooted.join(smallest, "root").select(*tags, "kept")
    return prints.filter("doc_id is not null").select("doc_id", *tags).distinct().join(merged, tags).select("doc_id", *tags, "kept")
