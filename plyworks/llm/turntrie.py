"""The prefix trie of conversations by partition refinement.

All conversations start as one class. A class is split by the next turn of its members; a class of one conversation is
retired, and the rest of its turns is emitted as a chain of nodes with one child each. What is summed over subtrees is
folded back from the leaves to the root.

Classes of more than `class_rows` rows are refined by Spark, a round for all of them: an aggregate tells how many further
turns all members of a class share, so these become a chain in one step however many they are, and the members are
split by the turn after it. Turns are compared by two 64-bit hashes of role and text, the texts themselves are never
moved. Smaller classes are refined inside a task, all classes of a slice at once, down to their leaves. Numbers of turns
come from ranges of all rows, so a conversation with a third of all turns is in no single task; ids that end in one node
are sorted by ranges, too, and hashed as a stream of pieces.

Defined results: rows without a conversation id take no part; null role or text is empty; turns follow their number,
null first, equal numbers by role and then by hash, and rows that repeat stay repeated turns; a conversation may have no
turns of its own after it is rebuilt and then ends in the root; very long texts count whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, if_small, running_start

NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: its first and last conversation and how many rows each has."""
    first, last, n_first, n_last = None, None, 0, 0
    for batch in batches:
        conv = np.asarray(batch.column(0))
        if not len(conv):
            continue
        first = conv[0] if first is None else first
        n_first += int((conv == first).sum())
        n_last = int((conv == conv[-1]).sum()) + (n_last if last == conv[-1] else 0)
        last = conv[-1]
    if first is not None:
        row = (TaskContext.get().partitionId(), int(first), n_first, int(last), n_last)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=["part", "first", "n_first", "last", "n_last"])


def _positions(before: dict[int, int]):
    """Sorted partitions with the place of each row in its conversation; before: rows of a partition's first conversation in earlier ones."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, had = None, before.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            conv = np.asarray(batch.column(0))
            if not len(conv):
                continue
            starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            many = np.diff(np.append(starts, len(conv)))
            pos = np.arange(len(conv)) - np.repeat(starts, many)
            if open_ is None or conv[0] == open_:
                pos[: many[0]] += had
            had, open_ = int(pos[-1]) + 1, conv[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pos), *batch.columns[1:]], names=["conv", "pos", "h1", "h2", "bytes"])

    return stream


def numbered_turns(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, h1, h2, bytes): a row per turn, pos from 0; bytes are those of the text in UTF-8."""
    role_, text_ = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    rows = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), role_.alias("role"),
        F.xxhash64(role_, text_).alias("h1"), F.xxhash64(F.lit(7), role_, text_).alias("h2"), F.octet_length(text_).cast("long").alias("bytes"),
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "h1", "h2"]
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "h1", "h2", "bytes"))
    edges = ranged.select("conv").mapInArrow(_edges, "part long, first long, n_first long, last long, n_last long").collect()  # a row a partition
    before, open_, had = {}, None, 0
    for e in sorted(edges):
        before[e.part] = had if e.first == open_ else 0
        had = e.n_last + (before[e.part] if e.first == e.last else 0)
        open_ = e.last
    return ranged.mapInArrow(_positions(before), "conv long, pos long, h1 long, h2 long, bytes long")


def with_sizes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with the number n of their conversation's turns, and members (conv, n)."""
    members = cut(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")))
    return cut(turns.join(members, "conv")), members


def grafted(turns: DataFrame, base, head) -> tuple[DataFrame, DataFrame]:
    """Turns (with n) and members (conv, n) of conversations rebuilt from the first `head` turns of conversation `base` and their own turns after the first `head`.

    base, head: columns of `conv`; few conversations have one base."""
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select("conv", "n", base.cast("long").alias("base"), head.cast("long").alias("head"))
    n_base = F.max(F.when(F.col("conv") == F.col("base"), F.col("n"))).over(Window.partitionBy("base"))
    plan = sizes.withColumn("taken", F.least("head", F.coalesce(n_base, F.lit(0))))
    plan = cut(plan.select("conv", "base", "head", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("n")))
    use = lambda source, first, end, shift: F.struct(source.alias("source"), first.cast("long").alias("first"), end.cast("long").alias("end"), shift.cast("long").alias("shift"))
    own = use(F.col("conv"), F.col("head"), F.lit(2**62), F.col("taken") - F.col("head"))
    uses = plan.select("conv", "n", F.inline(F.array(use(F.col("base"), F.lit(0), F.col("taken"), F.lit(0)), own))).filter("end > first")
    rows = turns.withColumnRenamed("conv", "source").join(uses, "source").filter("pos >= first and pos < end")
    return cut(rows.select("conv", "n", (F.col("pos") + F.col("shift")).alias("pos"), "h1", "h2", "bytes")), plan.select("conv", "n")


def _joined(ids) -> bytes:
    return ",".join(map(str, ids)).encode()


def refine_classes(cls, depth, parent, conv, n, pos, h1, h2, size) -> dict[str, np.ndarray]:
    """Nodes of the subtrees of classes: rows sorted by (cls, conv, pos), from the last turn that each class shares on."""
    start = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (cls[1:] != cls[:-1])))
    length, ids, top = np.diff(np.append(start, len(conv))), conv[start], depth[start]
    fresh = np.append(True, cls[start][1:] != cls[start][:-1])
    node = np.cumsum(fresh) - 1  # of each member
    at = start[fresh]
    levels = [{"conv": cls[at], "depth": depth[at], "up": np.full(len(at), -1), "n": np.bincount(node), "bytes": size[at]}]
    ends, base, k = np.full(len(start), -1), 0, 1  # ends: the node that a member ends in; base: the first node of the last level
    tails, ended = [], []  # members whose rows from k on are a chain of their own
    while True:
        alone = (levels[-1]["n"] == 1)[np.maximum(node - base, 0)] & (node >= base)
        over = (length == k) & (node >= base)
        ends[over] = node[over]
        tails.append((np.flatnonzero(alone & ~over), k))
        go = np.flatnonzero(~alone & (length > k) & (node >= base))
        if not len(go):
            break
        row = start[go] + k
        order = np.lexsort((ids[go], h2[row], h1[row], node[go]))
        go, row = go[order], row[order]
        new = np.append(True, (node[go][1:] != node[go][:-1]) | (h1[row][1:] != h1[row][:-1]) | (h2[row][1:] != h2[row][:-1]))
        base += len(levels[-1]["n"])
        own = base + np.cumsum(new) - 1
        levels.append({"conv": ids[go][new], "depth": top[go][new] + k, "up": node[go][new], "n": np.bincount(own - base), "bytes": size[row][new]})
        node[go] = own
        k += 1
    all_ = {c: np.concatenate([x[c] for x in levels]) for c in levels[0]}
    children = np.bincount(all_["up"][all_["up"] >= 0], minlength=len(all_["n"]))
    leaves, saved = (children == 0).astype(np.int64), (all_["n"] - 1) * all_["bytes"]
    stop = len(all_["n"])
    for level in reversed(levels[1:]):  # fold back: a level's nodes lie behind those of the level above
        first = stop - len(level["n"])
        np.add.at(leaves, level["up"], leaves[first:stop])
        np.add.at(saved, level["up"], saved[first:stop])
        stop = first
    sha = np.full(len(all_["n"]), NO_ENDS, object)
    done = np.flatnonzero(ends >= 0)
    done = done[np.lexsort((ids[done], ends[done]))]
    for own in np.split(done, np.flatnonzero(np.diff(ends[done])) + 1) if len(done) else ():
        sha[ends[own[0]]] = hashlib.sha256(_joined(ids[own].tolist())).hexdigest()
    up_conv = np.where(all_["up"] >= 0, all_["conv"][np.maximum(all_["up"], 0)], parent[start][fresh][np.minimum(np.arange(len(all_["n"])), len(at) - 1)])
    out = [[all_["conv"], all_["depth"], up_conv, all_["n"], children, leaves, saved, sha, np.arange(len(all_["n"])) < len(at)]]
    for who, k in tails:
        if not len(who):
            continue
        out[0][4][node[who]] = 1
        many = length[who] - k
        member = np.repeat(who, many)
        step = k + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        last = step == length[member] - 1
        tail_sha = np.full(len(member), NO_ENDS, object)
        tail_sha[last] = [hashlib.sha256(_joined([c])).hexdigest() for c in ids[who].tolist()]
        one = np.ones(len(member), np.int64)
        out.append([ids[member], top[member] + step, ids[member], one, (~last).astype(np.int64), one, 0 * one, tail_sha, np.zeros(len(member), bool)])
    return dict(zip([*COLUMNS, "top"], (np.concatenate(x) for x in zip(*out))))


def _refine(slice_rows: int = 1 << 16):
    """Rows sorted by (cls, conv, pos): the nodes of every class, a slice of whole classes at a time."""

    def nodes(cols: list[np.ndarray]) -> pa.RecordBatch:
        found = refine_classes(*cols)
        arrays = [pa.array(found[c].astype(np.int64)) for c in COLUMNS[:7]]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(found["ends_sha256"], pa.string()), pa.array(found["top"].astype(bool))], names=[*COLUMNS, "top"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([np.asarray(c) for c in batch.columns])
            rows += batch.num_rows
            if rows >= slice_rows:
                cols = [np.concatenate(x) for x in zip(*held)]
                stop = int(np.searchsorted(cols[0], cols[0][-1]))
                if stop:
                    yield nodes([c[:stop] for c in cols])
                held, rows = [[c[stop:] for c in cols]], len(cols[0]) - stop
        if rows:
            yield nodes([np.concatenate(x) for x in zip(*held)])

    return stream


def _pieces(most: int = 8192):
    """Rows (cls, depth, conv) in order: runs of ids of one node as texts, at most so many ids each."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, depth, conv = (np.asarray(c) for c in batch.columns)
            if not len(cls):
                continue
            starts = np.flatnonzero(np.append(True, (cls[1:] != cls[:-1]) | (depth[1:] != depth[:-1])))
            starts = np.unique(np.concatenate([starts, *[np.arange(a, b, most) for a, b in zip(starts, np.append(starts[1:], len(cls)))]]))
            text = [_joined(conv[a:b].tolist()).decode() for a, b in zip(starts, np.append(starts[1:], len(cls)))]
            yield pa.RecordBatch.from_arrays([pa.array(cls[starts]), pa.array(depth[starts]), pa.array(conv[starts]), pa.array(text, pa.string())], names=["cls", "depth", "first", "ids"])

    return stream


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (cls, depth, first): the hash of each node's ids."""
    open_, state = None, None

    def out(keys, shas):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(shas, pa.string())], names=["cls", "depth", "sha"])

    for batch in batches:
        keys, shas = [], []
        for cls, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (cls, depth) != open_:
                if state is not None:
                    keys.append(open_)
                    shas.append(state.hexdigest())
                open_, state = (cls, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield out(keys, shas)
    if state is not None:
        yield out([open_], [state.hexdigest()])


def ends_hashes(endings: DataFrame) -> DataFrame:
    """(cls, depth, sha) of the ids (cls, depth, conv) that end in each node, ascending and joined by commas."""
    order = ["cls", "depth", "conv"]
    pieces = endings.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces(), "cls long, depth long, first long, ids string")
    return pieces.repartition("cls", "depth").sortWithinPartitions("cls", "depth", "first").mapInArrow(_hash_pieces, "cls long, depth long, sha string")


def prefix_trie(turns: DataFrame, members: DataFrame, *, class_rows: int = 512) -> DataFrame:
    """A row per distinct prefix of the conversations, with the columns of NODE.

    turns: (conv, n, pos from 0, h1, h2, bytes), a written table; members: (conv, n), every conversation and its number of turns."""
    root, total, n_turns = members.agg(F.min("conv"), F.count(F.lit(1)), F.sum("n")).first()
    spark = turns.sparkSession
    if not total:
        return spark.createDataFrame([], NODE)
    long = lambda x: F.lit(x).cast("long")
    place = lambda c, d: F.struct(c.alias("cls"), d.alias("depth"))
    tops_of_none = spark.createDataFrame([(root, 0, None, total, 0, [(root, 0)])] if not n_turns else [], "cls long, depth long, parent long, size long, upto long, path array<struct<cls:long,depth:long>>")
    # `active`: the turns of all classes that are refined, from the last one that each class shares on; path: the classes above, and the class itself.
    active = turns.select("*", long(root).alias("cls"), long(0).alias("depth"), long(None).alias("parent"), long(total).alias("size"), F.array(place(long(root), long(0))).alias("path"))
    tops, chains, splits, small, single, endings = [tops_of_none], [], [], [], [], [members.filter("n = 0").select(long(root).alias("cls"), long(0).alias("depth"), "conv")]
    while n_turns:
        of_class = [F.first(c).alias(c) for c in ("depth", "parent", "size", "path")]
        shared = active.groupBy("cls", "pos").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h1", "h2")).alias("a"), F.max(F.struct("h1", "h2")).alias("b"), F.min("bytes").alias("bytes"), *of_class)
        shared = cut(shared.withColumn("same", (F.col("n") == F.col("size")) & (F.col("a") == F.col("b"))).drop("a", "b", "n"))
        upto = F.coalesce(F.min(F.when(~F.col("same"), F.col("pos"))), F.max("pos") + 1)
        found = cut(shared.groupBy("cls").agg(upto.alias("upto"), *of_class).select(*tops_of_none.columns))
        known = if_small(found.select("cls", "upto"))
        ahead = active.join(known, "cls")
        at = ahead.filter("pos = upto")
        parts = at.groupBy("cls", "h1", "h2").agg(F.min("conv").alias("child"), F.count(F.lit(1)).alias("members"), F.sum(F.col("n") - F.col("upto")).alias("rows"), F.first("upto").alias("upto"), F.first("path").alias("path"))
        parts = cut(parts.withColumn("kind", F.when(F.col("members") == 1, "single").when(F.col("rows") <= class_rows, "small").otherwise("large")))
        tops.append(found)
        chains.append(shared.join(known, "cls").filter("pos < upto").select("cls", "depth", "parent", "size", "pos", "bytes"))
        splits.append(parts.select("cls", "upto", "kind"))
        endings.append(ahead.filter("n = upto and pos = n - 1").select("cls", F.col("upto").alias("depth"), "conv"))
        below = F.col("upto") + 1
        moved = at.select("conv", "cls", "h1", "h2").join(parts, ["cls", "h1", "h2"]).select(
            "conv", F.col("child").alias("cls"), below.alias("depth"), F.col("cls").alias("parent"), F.col("members").alias("size"),
            F.when(F.col("kind") == "large", F.concat("path", F.array(place(F.col("child"), below)))).alias("path"), "kind")
        moved = cut(active.select("conv", "n", "pos", "h1", "h2", "bytes").join(moved, "conv").filter("pos >= depth - 1"))
        small.append(moved.filter("kind = 'small'"))
        single.append(moved.filter("kind = 'single'"))
        active = moved.filter("kind = 'large'").drop("kind")
        if parts.filter("kind = 'large'").isEmpty():
            break
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    shas = ends_hashes(union(endings))
    out = []
    classes, inner = union(tops), spark.createDataFrame([], "cls long, upto long, leaves long, saved long")
    kids, chain = spark.createDataFrame([], "cls long, upto long, n_children long, alone long"), spark.createDataFrame([], "cls long, depth long, parent long, size long, pos long, bytes long")
    if n_turns:
        inside = union(small).select("cls", "depth", "parent", "conv", "n", "pos", "h1", "h2", "bytes").repartition("cls").sortWithinPartitions("cls", "conv", "pos")
        inside = cut(inside.mapInArrow(_refine(), f"{NODE}, top boolean"))
        last, one = F.col("pos") + 1 == F.col("n"), long(1)
        alone = union(single).select(
            F.col("conv").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.when(F.col("pos") == F.col("depth") - 1, F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
            one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), long(0).alias("saved_tokens"),
            F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(NO_ENDS).alias("ends_sha256"),
        )
        out += [inside.select(*COLUMNS), alone]
        inner = inside.filter("top").groupBy(F.col("parent_conv_id").alias("cls"), (F.col("depth") - 1).alias("upto")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        kids = union(splits).groupBy("cls", "upto").agg(F.count(F.lit(1)).alias("n_children"), F.sum((F.col("kind") == "single").cast("long")).alias("alone"))
        chain = union(chains)
    # Folding back: what a class has by itself is added to it and to every class on its path.
    gain = (F.col("size") - 1) * F.col("bytes")
    zero = lambda c: F.coalesce(c, long(0))
    own = classes.join(kids, ["cls", "upto"], "left").join(inner, ["cls", "upto"], "left").join(chain.groupBy("cls", "depth").agg(F.sum(gain).alias("gain")), ["cls", "depth"], "left")
    own = cut(own.select(
        "cls", "depth", "parent", "size", "upto", "path", zero("n_children").alias("n_children"),
        F.when(F.col("n_children").isNull(), long(1)).otherwise(zero("alone") + zero("leaves")).alias("leaves"), (zero("saved") + zero("gain")).alias("saved"),
    ))
    totals = own.select(F.explode("path").alias("at"), "leaves", "saved").groupBy("at").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    folded = own.drop("path", "leaves", "saved").join(totals.select("at.*", "n_leaves", "saved_tokens"), ["cls", "depth"])
    run = running_start(chain.select("*", place(F.col("cls"), F.col("depth")).alias("chain"), F.floor(F.col("pos") / 4096).alias("segment")), "chain", "segment", ["pos"], gain, "before")
    folded = cut(folded)
    nodes = run.select("cls", "depth", (F.col("pos") + 1).alias("at"), "before").join(if_small(folded), ["cls", "depth"])
    nodes = nodes.withColumn("parent", F.when(F.col("at") == F.col("depth"), F.col("parent")).otherwise(F.col("cls")))
    top = folded.filter("depth = 0").select("*", long(0).alias("at"), long(0).alias("before"))
    nodes = nodes.unionByName(top).join(shas.withColumnRenamed("depth", "at"), ["cls", "at"], "left")
    out.append(nodes.select(
        F.col("cls").alias("conv_id"), F.col("at").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("size").alias("n_convs"),
        F.when(F.col("at") == F.col("upto"), F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("saved_tokens") - F.col("before")).alias("saved_tokens"),
        F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"),
    ))
    return union(out)


def conversation_trie(conversations: DataFrame, *, class_rows: int = 512, **columns) -> DataFrame:
    """The prefix trie of conversations as they are."""
    return prefix_trie(*with_sizes(numbered_turns(conversations, **columns)), class_rows=class_rows)


def node_turns(nodes: DataFrame, conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of `conversation_trie` with the role and text of their last turn (the root has none)."""
    role_, text_ = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    said = conversations.select(F.col(conv_id).cast("long").alias("conv"), F.xxhash64(role_, text_).alias("h1"), F.xxhash64(F.lit(7), role_, text_).alias("h2"), role_.alias("role"), text_.alias("text")).dropDuplicates(["conv", "h1", "h2"])
    turns = numbered_turns(conversations, conv_id=conv_id, turn=turn, role=role, text=text).join(said, ["conv", "h1", "h2"])
    return nodes.join(turns.select(F.col("conv").alias("conv_id"), (F.col("pos") + 1).alias("depth"), "role", "text"), ["conv_id", "depth"], "left")
