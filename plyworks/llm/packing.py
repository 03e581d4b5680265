"""Best-fit packing into bins of several permitted sizes.

Documents are dealt to shards by a hash of their id and size; each shard is packed by itself, largest piece first. A piece goes
into the open bin that it leaves fullest. If none has room, a bin is opened, of the size that costs least per word
(its size and a fixed amount) if it takes, of the pieces still to come in the shard, time and again the largest that fits. At
last each bin shrinks to the smallest permitted size that holds its contents. Texts longer than the largest size are
split into pieces of that size and a rest.

Defined results: a text without words is a piece of size 0 in bin -1; a null id is an id like any other; rows that
repeat an id and a size are told apart by their number among those; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from itertools import accumulate, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, text_tags, word_count

SIZES = (512, 1024, 2048, 4096)
#: Rows of the same id and size that are dealt together.
LOT = 1000
_PLACED = "doc_id long, copy long, piece int, size long, shard long, bin int, offset long, bin_size long, bin_used long"


def pack(sizes: list[int], capacities: tuple[int, ...], overhead: float = 32.0) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """Bin and offset of each piece (given largest first), and (size, words) of each bin. No piece exceeds the largest size."""
    room: list[tuple[int, int]] = []  # (room, bin) of open bins, sorted
    bins: list[list[int]] = []  # (capacity, used)
    falling, total = [-s for s in sizes], list(accumulate(sizes, initial=0))
    of, offset = [], []

    def fill(i: int, free: int) -> int:
        """Words of the pieces from `i` on that fit, each time the largest one that does."""
        used = 0
        while (i := bisect_left(falling, used - free, i)) < len(falling):
            k = bisect_right(total, total[i] + free - used, i) - 1
            used, i = used + total[k] - total[i], k
        return used

    for n, size in enumerate(sizes):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b = len(bins)
            cost = lambda c: (c + overhead) / (size + fill(n + 1, c - size))  # noqa: B023, E731
            capacity = min((c for c in capacities if c >= size), key=lambda c: (cost(c), c))
            bins.append([capacity, 0])
            free = capacity
        of.append(b)
        offset.append(bins[b][1])
        bins[b][1] += size
        if free > size:
            insort(room, (free - size, b))
    return of, offset, [(next(c for c in capacities if c >= used), used) for _, used in bins]


def pack_documents(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", capacities: tuple[int, ...] = SIZES, shard_rows: int = 20_000, tagged: bool = False) -> DataFrame:
    """A row per piece: doc_id, copy, piece, size, shard, bin, offset in the bin, bin_size and bin_used.

    With `tagged` also tag and tag2, two hashes of the text: rows that repeat an id and a size are told apart by them, and copies count equal texts."""
    tags = ["tag", "tag2"] if tagged else []
    capacities = tuple(sorted(capacities))
    most = capacities[-1]
    shards = max(1, -(-docs.count() // shard_rows))
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), word_count(F.col(text)).alias("size"), *(text_tags(text) if tagged else [])).groupBy("doc_id", "size", *tags).agg(F.count(F.lit(1)).alias("rows"))
    # What comes often is dealt in lots, so that no shard gets all of it.
    lots = sized.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {LOT}"))))
    lots = lots.select("doc_id", "size", *tags, (F.col("lot") * LOT).alias("first"), F.least(F.lit(LOT).cast("long"), F.col("rows") - F.col("lot") * LOT).alias("rows"), F.pmod(F.xxhash64("doc_id", "size", "lot", *tags), F.lit(shards)).alias("shard"))

    placed = _PLACED + "".join(f", {t} long" for t in tags)

    def task(group: pa.Table) -> pa.Table:
        ids = group["doc_id"].to_pylist()  # Python integers: exact, with nulls
        marks = list(zip(*(group[t].to_pylist() for t in tags))) or [()] * len(ids)
        shard = group["shard"][0].as_py() if group.num_rows else 0
        pieces = []
        for d, mark, n, first, rows in zip(ids, marks, *(group[c].to_pylist() for c in ("size", "first", "rows"))):
            parts = [min(most, n - k * most) for k in range(max(1, -(-n // most)))]
            pieces += [(s, d, first + c, k, mark) for c in range(rows) for k, s in enumerate(parts)]
        pieces.sort(key=lambda p: (-p[0], p[1] is not None, p[1] or 0, p[2], p[3], p[4]))
        real = [p for p in pieces if p[0] > 0]
        of, offset, bins = pack([p[0] for p in real], capacities)
        out = [(d, c, k, s, shard, b, o, *bins[b], *mark) for (s, d, c, k, mark), b, o in zip(real, of, offset)]
        out += [(d, c, k, 0, shard, -1, 0, 0, 0, *mark) for s, d, c, k, mark in pieces if s == 0]
        names = [x.split()[0] for x in placed.split(", ")]
        kinds = [pa.int32() if x.endswith(" int") else pa.int64() for x in placed.split(", ")]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, list(zip(*out)) or [[]] * len(names), kinds)})

    return lots.groupBy("shard").applyInArrow(task, placed)


def cut_text(text: str | None, most: int) -> list[str | None]:
    """A text in pieces of `most` words and a rest; joined, they are the text."""
    starts = [m.start() for m in islice(re.finditer(WORD, text or ""), most, None, most)]
    return [text] if not starts else [text[a:b] for a, b in zip([0, *starts], [*starts, len(text)])]


def packed_texts(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", capacities: tuple[int, ...] = SIZES, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """The pieces of `pack_documents` with their texts and the columns `keep`: what a bin holds, in the order of its offsets.

    The pieces of a copy of a text, joined in order, are that text. Pieces meet their texts by id and two hashes."""
    most = max(capacities)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(values: pd.Series) -> pd.Series:
        return pd.Series([cut_text(t, most) for t in values], dtype=object)

    bins = pack_documents(docs, text=text, doc_id=doc_id, capacities=capacities, tagged=True, **options)
    own = docs.select(F.col(doc_id).cast("long").alias("__id"), *text_tags(text), *keep, F.col(text).alias("__text")).dropDuplicates(["__id", "tag", "tag2"])
    held = bins.join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & (bins["tag"] == own["tag"]) & (bins["tag2"] == own["tag2"])).drop(own["tag"]).drop(own["tag2"])
    whole = (F.col("piece") == 0) & (F.col("size") < most)
    part = F.when(whole, F.col("__text")).otherwise(F.get(pieces(F.when(~whole, F.col("__text"))), F.col("piece")))
    return held.withColumn(text, part).drop("__id", "__text")
