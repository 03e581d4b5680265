"""Ranked lexical search over documents that recursive graph bisection has reordered.

A bounded sample of documents (`sample_docs`, smallest hash first) is bisected level by level: documents of the two halves
of a node are swapped while that lowers the logarithmic cost of the gaps between documents that hold a term. At every
node this leaves, for each of `buckets` term hashes, how much dearer a document with such a term would be in the one half
than in the other. All documents are then led down the tree by the sum over their terms, so that those with terms in
common lie in one leaf. A leaf is dealt into shards that are bounded in documents and postings; a shard is one row of
the index, an inverted index of its own with all its terms. Where a document lies decides how much a search reads, never
what it finds.

A search goes over the shards by their bounds: an item's bound in a shard adds up, over its terms, the weight times the
largest factor that a document of the shard has. The best shards by bound are visited first, in rounds that grow; shards
whose bound lies below the score of an item's k-th document so far are never visited, and what is left once no such
shard remains is exact. Inside a shard documents have numbers of their own; these are mapped back to ids for ties.

Items are taken in blocks of `block_items`, so the driver and a task hold a block's terms at most.

Defined results: a document without terms (null or empty text) is in no count and never found; a null id takes part and
sorts before every other among equal scores; rows that repeat an id are separate documents; an item without terms has no
rows; rows that repeat an item are one, and an item id with several texts is one item for each; very long texts count
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, if_small, stored

NO_ID = -(2**63)
#: Bytes of a term: digits, letters, everything beyond ASCII; A-Z are lower-cased, all others are gaps.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RESULT = "item_id long, rank int, doc_id long, score long"
_SHARD = "shard long, docs binary, lengths binary, vocabulary binary, starts binary, holders binary, counts binary"


def terms_of(text: str | None) -> Counter:
    """Terms of a text (bytes) and how often each occurs."""
    return Counter((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())


def bucket_of(terms, buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, terms), np.int64) % buckets


# the order of documents


@dataclass
class Bisection:
    """For each level, how much dearer a term is in the second half of a node than in the first (node, bucket), and where the halves part."""

    tables: list[np.ndarray]
    cuts: list[np.ndarray]
    buckets: int

    def leaves(self, sets: list[np.ndarray]) -> np.ndarray:
        """The leaf of each document, given the term hashes that it holds; equal sets have one leaf."""
        sets = [np.unique(s) for s in sets]
        doc, term = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.int64)
        node = np.zeros(len(sets), np.int64)
        for table, part in zip(self.tables, self.cuts):
            gain = np.bincount(doc, table[node[doc], term], len(sets))
            node = 2 * node + (gain <= part[node])
        return node


def _gap_cost(degree: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Cost of the gaps of a term that `degree` of `size` documents hold."""
    return degree * np.log2(np.maximum(size, 1) / (degree + 1.0))


def bisect(sets: list[np.ndarray], levels: int, buckets: int, rounds: int = 10) -> Bisection:
    """Recursive graph bisection of documents given as sets of term hashes."""
    n = len(sets)
    doc, term = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.int64)
    node, tables, cuts = np.zeros(n, np.int64), [], []
    for level in range(levels):
        width = 1 << level
        by = np.argsort(node, kind="stable")
        many = np.bincount(node, minlength=width)
        place = np.empty(n, np.int64)
        place[by] = np.arange(n) - np.repeat(np.cumsum(many) - many, many)
        side = (2 * place >= many[node]).astype(np.int64)
        for last in [*[False] * rounds, True]:
            degree = np.bincount((2 * node[doc] + side[doc]) * buckets + term, minlength=2 * width * buckets).reshape(width, 2, buckets).astype(float)
            size = np.bincount(2 * node + side, minlength=2 * width).reshape(width, 2, 1)
            now = _gap_cost(degree, size)
            more = _gap_cost(degree + 1, size) - now  # what one document more with the term costs a half
            if last:
                break
            less = now - _gap_cost(np.maximum(degree - 1, 0), size)
            move = np.stack([less[:, 0] - more[:, 1], less[:, 1] - more[:, 0]], axis=1)  # what is gained by moving from each half
            gain = np.bincount(doc, move[node[doc], side[doc], term], n)
            by = np.lexsort((-gain, side, node))
            counts = np.bincount(2 * node + side, minlength=2 * width)
            nth = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)  # best first in each half
            pairs = node[by] * n + nth
            a, b = by[side[by] == 0], by[side[by] == 1]
            _, i, j = np.intersect1d(pairs[side[by] == 0], pairs[side[by] == 1], assume_unique=True, return_indices=True)
            swap = gain[a[i]] + gain[b[j]] > 1e-9
            if not swap.any():
                break
            side[a[i][swap]], side[b[j][swap]] = 1, 0
        table = (more[:, 1] - more[:, 0]).astype(np.float32)
        lean = np.bincount(doc, table[node[doc], term], n)
        part = np.zeros(width)
        for k in range(width):
            if many[k]:
                part[k] = np.median(lean[node == k])
        tables.append(table)
        cuts.append(part)
        node = 2 * node + (lean <= part[node])
    return Bisection(tables, cuts, buckets)


def fit_order(docs: DataFrame, levels: int, *, text: str, doc_id: str, sample_docs: int, buckets: int, rows: int) -> Bisection:
    """The bisection of a sample: the documents with the smallest hashes of id and text."""
    place = F.xxhash64(doc_id, text) / F.lit(2.0**64) + 0.5
    near = docs.filter(place <= (1.25 * sample_docs + 256) / max(rows, 1)).withColumn("__place", place)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(bucket_of(terms_of(t), buckets)).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["place", "own"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.frombuffer(x, np.int32).astype(np.int64) for b in batches for x in b.column(0).to_pylist()]
        model = bisect([x for x in own if len(x)], levels, buckets)
        yield pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in model.tables], pa.binary()), pa.array([c.tobytes() for c in model.cuts], pa.binary())], names=["part", "at"])

    sample = near.select("__place", text).mapInArrow(sets, "place double, own binary").orderBy("place", "own").limit(sample_docs)
    found = sample.select("own").coalesce(1).mapInArrow(fit, "part binary, at binary").collect() if levels else []
    return Bisection([np.frombuffer(r.part, np.float32).reshape(-1, buckets) for r in found], [np.frombuffer(r["at"], np.float64) for r in found], buckets)


# the index


@dataclass
class Index:
    shards: DataFrame
    n_docs: int  # documents with a term
    n_terms: int  # all their terms, with repeats


def _postings(order: Bisection):
    """Rows (doc, text): leaf, doc, n, distinct, and the document's terms with their counts."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                held = [(d, c) for d, c in zip(part.column(0).to_pylist(), map(terms_of, part.column(1).to_pylist())) if c]
                leaf = order.leaves([bucket_of(c, order.buckets) for _, c in held]) if held else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(leaf), pa.array([d for d, _ in held], pa.int64()), pa.array([c.total() for _, c in held], pa.int64()), pa.array([len(c) for _, c in held], pa.int64()),
                    pa.array([b" ".join(c) for _, c in held], pa.binary()), pa.array([np.fromiter(c.values(), np.uint32, len(c)).tobytes() for _, c in held], pa.binary()),
                ], names=["leaf", "doc", "n", "distinct", "terms", "tfs"])

    return stream


def _least_type(x: np.ndarray) -> bytes:
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _typed(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{max(1, len(raw) // max(n, 1))}").astype(np.int64)


def _shards(most_postings: int):
    """Rows (shard, doc, n, terms, tfs) sorted by shard: an inverted index for each shard, in several rows if its texts are very long."""

    def packed(shard, docs, lengths, terms, tfs):
        vocabulary: dict[bytes, int] = {}
        codes = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in t.split(b" ")), np.int64) for t in terms]
        code, holder = np.concatenate(codes), np.repeat(np.arange(len(docs)), [len(c) for c in codes])
        count = np.concatenate([np.frombuffer(t, np.uint32) for t in tfs])
        order = np.argsort(code, kind="stable")
        starts = np.cumsum(np.bincount(code, minlength=len(vocabulary))).astype(np.uint32)
        return shard, np.array(docs, np.int64).tobytes(), np.array(lengths, np.int64).tobytes(), b" ".join(vocabulary), starts.tobytes(), _least_type(holder[order]), _least_type(count[order])

    def rows(done) -> pa.RecordBatch:
        kinds = [pa.int64(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=["shard", "docs", "lengths", "vocabulary", "starts", "holders", "counts"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, postings = None, [], 0
        for batch in batches:
            for key, doc, n, terms, tfs in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (key != shard or postings >= most_postings):
                    yield rows([packed(shard, *zip(*held))])
                    held, postings = [], 0
                shard = key
                held.append((NO_ID if doc is None else doc, n, terms, tfs))
                postings += len(tfs) // 4
        if held:
            yield rows([packed(shard, *zip(*held))])

    return stream


def build_index(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shard_docs: int = 512, shard_postings: int = 1 << 18, max_levels: int = 7, sample_docs: int = 4096, buckets: int = 1 << 14,
) -> Index:
    """The clustered index of all documents. Leaves are as many as shards of `shard_docs` documents need, but 2 ** `max_levels` at most."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    rows = source.count()
    levels = max(0, min(max_levels, math.ceil(math.log2(max(rows, 1) / shard_docs))))
    order = fit_order(source, levels, text="text", doc_id="doc", sample_docs=sample_docs, buckets=buckets, rows=rows)
    held = source.mapInArrow(_postings(order), "leaf long, doc long, n long, distinct long, terms binary, tfs binary")
    held = stored(held.withColumn("row", F.monotonically_increasing_id()))
    leaves = held.groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"), F.sum("distinct").alias("postings"), F.sum("n").alias("n")).collect()  # 2 ** max_levels rows at most
    parts = {r.leaf: max(math.ceil(r.docs / shard_docs), math.ceil(r.postings / shard_postings)) for r in leaves}
    starts, upto = {}, 0
    for leaf in sorted(parts):
        starts[leaf], upto = upto, upto + parts[leaf]
    deal = F.lit(0).cast("long")
    if parts:
        pick = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("leaf")).cast("long")
        deal = pick(starts) + F.pmod(F.xxhash64("row"), pick(parts))  # rows, not ids: repeated documents are dealt, too
    dealt = held.select(deal.alias("shard"), "row", "doc", "n", "terms", "tfs").repartition("shard").sortWithinPartitions("shard", "row")
    shards = stored(dealt.select("shard", "doc", "n", "terms", "tfs").mapInArrow(_shards(4 * shard_postings), _SHARD))
    return Index(shards, sum(r.docs for r in leaves), sum(r.n for r in leaves))


# the search


@dataclass
class _Block:
    """Items of a block: their terms as codes, one run an item."""

    codes: dict[bytes, int]
    item_codes: np.ndarray
    item_starts: np.ndarray

    @classmethod
    def of(cls, items: list[list[bytes]]) -> _Block:
        codes: dict[bytes, int] = {}
        runs = [[codes.setdefault(t, len(codes)) for t in terms] for terms in items]
        return cls(codes, np.array([c for r in runs for c in r], np.int64), np.cumsum([0, *map(len, runs)]))

    def of_item(self, i: int) -> np.ndarray:
        return self.item_codes[self.item_starts[i] : self.item_starts[i + 1]]


class _Shard:
    """A row of the index with the postings of a block's terms: code, start, end, and for each posting its document and factor."""

    def __init__(self, row: dict, block: _Block, index_docs: int, index_terms: int):
        self.docs, lengths = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["lengths"], np.int64)
        ends = np.frombuffer(row["starts"], np.uint32).astype(np.int64)
        asked = [(k, c) for k, w in enumerate(row["vocabulary"].split(b" ")) if (c := block.codes.get(w)) is not None]
        place, self.code = np.array([k for k, _ in asked], np.int64), np.array([c for _, c in asked], np.int64)
        start = np.where(place > 0, ends[np.maximum(place - 1, 0)], 0) if len(place) else place
        self.df = ends[place] - start if len(place) else place
        self.end = np.cumsum(self.df)
        self.start = self.end - self.df
        rows = np.arange(self.df.sum()) + np.repeat(start - self.start, self.df)
        n = int(ends[-1])
        self.holder, tf = _typed(row["holders"], n)[rows], _typed(row["counts"], n)[rows]
        m = 50 + 50 * lengths * index_docs // index_terms
        self.factor = 1_000_000_000 * tf // (1000 * tf + 20 * m[self.holder])

    def most(self) -> np.ndarray:
        return np.maximum.reduceat(self.factor, self.start) if len(self.start) else np.zeros(0, np.int64)


def _facts(block: _Block, n_docs: int, n_terms: int):
    """For each row of the index: which of the block's terms it has, in how many documents, and the largest factor of each."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                s = _Shard(row, block, n_docs, n_terms)
                out.append((row["shard"], s.code.astype(np.int32).tobytes(), s.df.astype(np.int32).tobytes(), s.most().tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["shard", "codes", "df", "most"])

    return stream


def _frequencies(size: int):
    """In how many documents each term of the block occurs: one sum a task."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for codes, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[np.frombuffer(codes, np.int32)] += np.frombuffer(df, np.int32)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["code", "df"])

    return stream


def _bounds(block: _Block, weights: np.ndarray):
    """For each row of the index the bound of each item that has a term there."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for shard, codes, most in zip(*(c.to_pylist() for c in batch.columns)):
                worth = np.zeros(len(weights), np.int64)
                codes = np.frombuffer(codes, np.int32)
                worth[codes] = weights[codes] * np.frombuffer(most, np.int64)
                bound = np.add.reduceat(worth[block.item_codes], block.item_starts[:-1])
                has = np.flatnonzero(bound > 0)
                parts.append((has, np.full(len(has), shard), bound[has]))
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item", "shard", "bound"])

    return stream


def _scores(block: _Block, weights: np.ndarray, least: np.ndarray, k: int, n_docs: int, n_terms: int):
    """Rows of the index with the items that visit them: each item's k best documents there that score `least` or more."""

    def best(s: _Shard, items: list[int]):
        worth = weights[np.repeat(s.code, s.df)] * s.factor
        at = np.full(len(weights), -1)
        at[s.code] = np.arange(len(s.code))
        for i in items:
            total = np.zeros(len(s.docs), np.int64)
            for t in (own := at[block.of_item(i)])[own >= 0].tolist():
                run = slice(s.start[t], s.end[t])
                total[s.holder[run]] += worth[run]  # a document once a term
            good = np.flatnonzero(total >= max(least[i], 1))
            if len(good) > k:
                good = good[total[good] >= np.partition(total[good], -k)[-k]]
            good = good[np.lexsort((s.docs[good], -total[good]))[:k]]
            yield np.full(len(good), i), s.docs[good], total[good]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [x for row in batch.to_pylist() for x in best(_Shard(row, block, n_docs, n_terms), row["items"])]
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item", "doc", "score"])

    return stream


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))).filter(F.col("rank") <= k)


def _search_block(index: Index, items: list[tuple], k: int, rounds: tuple[int, ...]) -> DataFrame:
    spark, block = index.shards.sparkSession, _Block.of([t for _, t in items])
    facts = cut(index.shards.mapInArrow(_facts(block, index.n_docs, index.n_terms), "shard long, codes binary, df binary, most binary"))
    summed = facts.select("codes", "df").mapInArrow(_frequencies(len(block.codes)), "code long, df long").groupBy("code").agg(F.sum("df").alias("df"))
    weights = np.zeros(len(block.codes), np.int64)
    for r in summed.collect():  # a block's terms at most
        weights[r.code] = math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * r.df + 1)))
    bounds = facts.select("shard", "codes", "most").mapInArrow(_bounds(block, weights), "item long, shard long, bound long")
    bounds = cut(bounds.groupBy("item", "shard").agg(F.max("bound").alias("bound")))
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "shard"))
    best = cut(bounds.withColumn("nth", nth).filter(F.col("nth") <= max(rounds)))
    least, found, seen = np.zeros(len(items), np.int64), [], 0
    for upto in (*rounds, None):
        stop = spark.createDataFrame([(i, int(x)) for i, x in enumerate(least)], "item long, least long")  # a block's items at most
        left = best.filter((F.col("nth") > seen) & (F.col("nth") <= upto)) if upto else bounds.join(if_small(best.select("item", "shard")), ["item", "shard"], "left_anti")
        visits = left.join(F.broadcast(stop), "item").filter("bound >= least").groupBy("shard").agg(F.collect_list("item").alias("items"))  # a block's items at most
        visits = cut(visits)
        scored = index.shards.join(if_small(visits), "shard").select(*index.shards.columns, "items").mapInArrow(_scores(block, weights, least, k, index.n_docs, index.n_terms), "item long, doc long, score long")
        found.append(cut(_ranked(scored, k).select("item", "doc", "score")))
        seen = upto
        together = found[0]
        for f in found[1:]:
            together = together.unionByName(f)
        if upto:
            full = _ranked(together, k).groupBy("item").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
            for r in full.collect():  # a block's items at most
                least[r.item] = r.score
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item long, item_id long")
    ranked = _ranked(together, k).join(F.broadcast(names), "item")
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score")


def search(index: Index, items: DataFrame, *, k: int = 50, item_id: str = "item_id", text: str = "text", block_items: int = 1024, rounds: tuple[int, ...] = (2, 16)) -> DataFrame:
    """The k documents that score highest for each item: item_id, rank, doc_id, score."""

    @F.udf(T.ArrayType(T.BinaryType()))
    def terms(value):
        return list(terms_of(value))

    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).distinct().select("item_id", terms("text").alias("terms"))
    spark, out, block = items.sparkSession, [], []
    for row in cut(asked.filter(F.size("terms") > 0).orderBy("item_id")).toLocalIterator():
        block.append((row.item_id, [bytes(t) for t in row.terms]))
        if len(block) == block_items:
            out.append(stored(_search_block(index, block, k, rounds)))
            block = []
    if block:
        out.append(stored(_search_block(index, block, k, rounds)) if out else _search_block(index, block, k, rounds))
    result = spark.createDataFrame([], _RESULT)
    for part in out:
        result = part if result is None or len(out) == 1 else result.unionByName(part)
    return result
