"""Approximate nearest neighbours by collision counting over single projections.

Every vector is projected on `n_lines` lines, whose directions stand upright on each other as far as the dimensions
allow; each line keeps its projections as one sorted array. A query opens a window around its own projection on every
line and widens all windows by a factor, level by level (virtual rehashing: no table is built anew). A vector that lies
in the windows of `threshold` of the lines is verified by its true distance. From the width of the windows follows the
distance within which a vector is very likely to have met the threshold; a query ends once its k-th distance is below
that, or its windows hold all. So how much is verified follows from the data: little where there are close neighbours.

Spark deals the vectors and the queries into blocks; a task searches one block for one block of queries, and each
query's answers from all blocks are merged. Every vector is indexed, and a window grows until it is wide enough, so
there is no cap on what a line may hold. Blocks have the same number of rows at any size of the table, fewer where vectors
are so long that a block would have over `block_bytes`.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither do rows
without an id, nor vectors of another length than the query's; vectors of any length are projected whole; rows that
share an id are separate candidates, but none is a neighbour of a query of the same id; equal distances go to the
smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_FOUND = "query_id long, vec_id long, score double"


def directions(n: int, dims: int, seed: int = 3) -> np.ndarray:
    """n unit vectors: random bases of all dimensions, one after the other."""
    rng = np.random.default_rng([seed, dims])
    return np.concatenate([np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(-(-n // dims))], axis=1)[:, :n]


def reach(n_lines: int, threshold: int, dims: int, margin: float = 0.7) -> float:
    """How many half windows away a vector may be that meets the threshold, by `margin` standard deviations, on the lines."""
    low, high = threshold / n_lines, 1.0
    for _ in range(50):
        p = (low + high) / 2
        low, high = (p, high) if n_lines * p - margin * (n_lines * p * (1 - p)) ** 0.5 < threshold else (low, p)
    return dims**0.5 / NormalDist().inv_cdf((1 + high) / 2)  # a difference is spread over the lines like a normal one


def search_block(ids, vectors, query_ids, queries, *, k: int, n_lines: int, threshold: int, growth: float, cells: int = 1 << 22):
    """(query row, vector row, distance) of the k nearest found for each query, nearest first."""
    n, dims = vectors.shape
    lines = directions(n_lines, dims)
    placed = np.ascontiguousarray((vectors @ lines).T)
    order = np.argsort(placed, axis=1, kind="stable").astype(np.int32)
    sorted_ = np.take_along_axis(placed, order, axis=1)
    asked, far = np.ascontiguousarray((queries @ lines).T), reach(n_lines, threshold, dims)
    first = max(float(np.median(np.abs(placed - np.median(placed)))) * 0.25, 1e-12)
    out = []
    step = max(1, cells // n)
    for at in range(0, len(queries), step):
        q = slice(at, at + step)
        m = len(queries[q])
        hits, left, right = np.zeros(m * n, np.int16), np.zeros((n_lines, m), np.int64), np.zeros((n_lines, m), np.int64)
        for j in range(n_lines):
            left[j] = right[j] = np.searchsorted(sorted_[j], asked[j, q])
        seen, going, half = np.zeros(m * n, bool), np.arange(m), first
        row, col, gap, kth = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(m, np.inf)  # the nearest so far
        while len(going):
            for j in range(n_lines):
                centre = asked[j, q][going]
                new_left, new_right = np.searchsorted(sorted_[j], centre - half), np.searchsorted(sorted_[j], centre + half, side="right")
                for a, b in ((new_left, left[j][going]), (right[j][going], new_right)):  # only what the wider window adds
                    size = np.maximum(b - a, 0)
                    rank = np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)
                    hits[np.repeat(going * n, size) + order[j][rank]] += 1  # each vector once a line
                left[j][going], right[j][going] = np.minimum(new_left, left[j][going]), np.maximum(new_right, right[j][going])
            fresh = np.flatnonzero((hits >= threshold) & ~seen)
            seen[fresh] = True
            fresh = fresh[ids[fresh % n] != query_ids[q][fresh // n]]
            for a in range(0, len(fresh), 1 << 15):
                r, c = fresh[a : a + (1 << 15)] // n, fresh[a : a + (1 << 15)] % n
                d = vectors[c] - queries[q][r]
                d = np.sqrt(np.einsum("ij,ij->i", d, d))
                near = d <= kth[r]
                row, col, gap = np.append(row, r[near]), np.append(col, c[near]), np.append(gap, d[near])
                best = np.lexsort((ids[col], gap, row))
                row, col, gap = row[best], col[best], gap[best]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                full = nth == k - 1
                kth[row[full]] = gap[full]
                row, col, gap = row[nth < k], col[nth < k], gap[nth < k]
            whole = (left == 0).all(axis=0) & (right == n).all(axis=0)
            going = going[~((kth <= half * far) | whole)[going]]
            half *= growth
        out.append((row + at, col, gap))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _search(**options):
    def task(group: pa.Table) -> pa.Table:
        asks = np.asarray(group["is_query"])
        ids = np.asarray(group["id"])
        lengths = np.asarray(group["dims"])
        flat = group["vector"].combine_chunks()
        flat = np.asarray(flat.values if hasattr(flat, "values") else flat.flatten(), dtype=np.float64)
        start = np.concatenate([[0], np.cumsum(lengths)])
        parts = []
        for dims in np.unique(lengths[asks]):
            q, v = np.flatnonzero(asks & (lengths == dims)), np.flatnonzero(~asks & (lengths == dims))
            if len(v):
                of = lambda rows: flat[start[rows][:, None] + np.arange(dims)]  # noqa: B023, E731
                row, col, gap = search_block(ids[v], of(v), ids[q], of(q), **options)
                parts.append((ids[q][row], ids[v][col], gap))
        cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return task


def nearest(
    vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, n_lines: int = 64,
    threshold: int = 44, growth: float = 1.08, block_rows: int = 1 << 14, query_rows: int = 256, block_bytes: int = 1 << 23,
) -> DataFrame:
    """query_id, rank, vec_id, score: for ids divisible by `every`, the k nearest vectors found (Euclidean)."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("vector")).filter("id is not null and vector is not null")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~bad & F.exists("vector", lambda x: x != 0)).withColumn("dims", F.size("vector"))
    n, n_queries, widest = rows.agg(F.count(F.lit(1)), F.count_if(F.col("id") % every == 0), F.max("dims")).first()
    block_rows = max(1, min(block_rows, block_bytes // (8 * (widest or 1))))  # so a task's memory has a bound at any number of dimensions
    # Few queries are dealt in small blocks, for more tasks; this changes no answer. Many are dealt in blocks as large as the vectors'.
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-n_queries // min(max(query_rows, n_queries // 64), block_rows)))
    key = F.xxhash64("id", "vector")
    each = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    base = rows.select("id", "vector", "dims", F.lit(False).alias("is_query"), F.pmod(key, F.lit(blocks)).alias("block"), each.alias("query_block"))
    asks = rows.filter(F.col("id") % every == 0).select("id", "vector", "dims", F.lit(True).alias("is_query"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(key, F.lit(query_blocks)).cast("int").alias("query_block"))
    task = _search(k=k, n_lines=n_lines, threshold=threshold, growth=growth)
    found = base.unionByName(asks).groupBy("block", "query_block").applyInArrow(task, _FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
