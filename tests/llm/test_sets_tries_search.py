"""Min-hash groups, the prefix trie and ranked search against plain versions, with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyworks.llm import lexical, minhash, similar, turntrie
from plyworks.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, node long, lead string, component_id string, n int, score long, item string, rank string, leaf int, row int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "en", 1, "x", "y", 2, 3, "z", "r", 4, 5) for r in rows], DOCS)


# 11 min-hash


def plain_sets(rows, width=2):
    """A list of (id, set) for rows (id, text)."""
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append((i, {" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    return out


def plain_groups(rows, width=2):
    """(id, set size, smallest id reachable) of each row."""
    sets = plain_sets(rows, width)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        ids[find(i)].append(d)
    least = lambda i: min((d for d in ids[find(i)] if d is not None), default=None)
    return Counter((d, len(s), least(i)) for i, (d, s) in enumerate(sets))


def near_rows(seed):
    """Clusters and chains of near copies, exact copies, odd rows, and an id with several texts."""
    rng = np.random.default_rng(seed)
    words, texts = [f"V{k}" for k in range(2000)], []
    for c in range(5):
        base = [words[k] for k in rng.integers(0, 2000, 90)]
        for k in range(12):
            if c % 2:
                base = [words[int(rng.integers(0, 2000))] if i // 3 == k else w for i, w in enumerate(base)]
                texts.append(" ".join(base))
            else:
                texts.append(" ".join(words[int(rng.integers(0, 2000))] if x < 0.04 else w for x, w in zip(rng.random(90), base)))
    texts += ["", None, " \t\n", "One", "one", "one two", "One  two", "two one", texts[0], texts[3].lower(), "long word " * 30000]
    rows = [(int(k), texts[k]) for k in rng.permutation(len(texts))]
    return rows + [(None, texts[1]), (None, "nobody else has this"), (None, None), (7, texts[20]), (7, texts[20]), (7, texts[40]), (3, None)]


@pytest.mark.parametrize("max_group,max_texts,max_bytes", [(4096, 2000, 1 << 24), (3, 4, 1 << 24), (4096, 2000, 4000)])
def test_min_hash_groups(spark, max_group, max_texts, max_bytes):
    rows = near_rows(max_group + max_texts)
    got = minhash.near_sets(docs_of(spark, rows), width=2, least=0.8, max_group=max_group, max_texts=max_texts, max_bytes=max_bytes).collect()
    want = plain_groups(rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert len({k[2] for k in want}) > 5 and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_min_hash_of_nothing(spark):
    assert minhash.near_sets(docs_of(spark, [])).collect() == []
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_sets(docs_of(spark, [(1, None), (2, ""), (2, "")])).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True)}


def test_long_texts_are_checked_in_bounded_blocks(spark):
    """2,000 long near copies of one text, with a bound of bytes that four of them reach."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(1200)]
    rows = [(k, " ".join("x" if i == at else w for i, w in enumerate(base))) for k, at in enumerate(rng.integers(0, 1200, 2000).tolist())]
    got = minhash.near_sets(docs_of(spark, rows), width=2, max_bytes=1 << 16, max_group=500).collect()
    assert len(got) == 2000 and {r.component_id for r in got} == {0}


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_packed_signatures(bits):
    rng = np.random.default_rng(bits)
    a, b = (rng.integers(0, 1 << 32, 150, np.uint32) for _ in range(2))
    b[:100] = a[:100]
    low = (1 << bits) - 1
    plain = sum(int(x) & low != int(y) & low for x, y in zip(a, b))
    assert minhash.unequal_slots(minhash.pack(a, bits)[None], minhash.pack(b, bits), bits).tolist() == [plain]


def test_estimates_are_corrected_for_chance():
    rng, errors = np.random.default_rng(1), []
    for share in (0.5, 0.7, 0.8, 0.9):
        for _ in range(10):
            both, n = rng.integers(0, 1 << 63, 600).astype(np.uint64), int(600 * (1 - share) / share / 2)
            a, b = (np.concatenate([both, rng.integers(0, 1 << 63, n).astype(np.uint64)]) for _ in range(2))
            x, y = (minhash.pack(minhash.minima(s, 200), 2) for s in (a, b))
            errors.append(minhash.estimate(minhash.unequal_slots(x[None], y, 2)[0], 200, 2) - 600 / (600 + 2 * n))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06
    most = minhash.most_unequal(0.8, 200, 2, 5)
    assert minhash.estimate(most, 200, 2) < 0.65 and minhash.estimate(most, 200, 2) > 0.5


def test_bands_stream_over_batches():
    import pyarrow as pa

    leads = [1, 2, 2, 3, 4, 4, 4, 4, 4, 5, 6, 6, 6, 7]
    for size in range(1, 15):
        batches = [pa.RecordBatch.from_arrays([pa.array(leads[a : a + size], pa.int64()), pa.array(range(a, min(14, a + size)), pa.int64())], names=["lead", "node"]) for a in range(0, 14, size)]
        rows = [r for b in minhash.shared_bands(3)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(r[:2] for r in rows if r[2] is None) == [(2, 1), (2, 2), (6, 10), (6, 11), (6, 12)]
        assert sorted(r for r in rows if r[2] is not None) == [(4, k, 4) for k in range(4, 9)]


def test_forest_joins_all_alike():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 63, (60, 7)).astype(np.uint64)
    for i in range(1, 60):
        if i % 3:
            words[i] = words[i - 1] ^ (np.uint64(1) << rng.integers(0, 63, 7).astype(np.uint64))
    label = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if minhash.unequal_slots(words[i : i + 1], words[j], 2)[0] <= 9:
                    label[i] = min(label[i], label[j])
    got = list(range(60))
    for i, j in minhash.alike_forest(words, 2, 9):
        a, b = got[i], got[j]
        got = [min(a, b) if x in (a, b) else x for x in got]
    assert got == label and 1 < len(set(label)) < 60


# 12 the prefix trie

TURNS = "conv_id long, turn long, role string, text string, conv string, pos string, cls int, depth int, n int, size int"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "c", "p", 1, 2, 3, 4) for r in rows], TURNS)


def plain_trie(conversations):
    """Nodes of {id: [(role, text), ...]}, as the rows of the contract."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    up = lambda p: p[:-1] if p else None
    children = Counter(up(p) for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, who in members.items():
        ends = sorted(c for c in who if len(conversations[c]) == len(p))
        out.append((min(who), len(p), min(members[up(p)]) if p else None, len(who), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return Counter(out)


def plain_turns(rows):
    own = defaultdict(list)
    for c, n, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        own[c].append((role or "", text or ""))
    return own


def trie_rows(df):
    return Counter(tuple(r) for r in df.select(*turntrie.COLUMNS).collect())


def made_conversations(seed, n=120):
    rng, rows = np.random.default_rng(seed), []
    for c in range(n):
        for t in range(int(rng.integers(1, 7))):
            rows.append((c * 3 - 40, t, "user" if t % 2 == 0 else "assistant", ["same", "älso", "third " * 9][int(rng.integers(0, 3))]))
    long = [(1000 + c, t, "user", f"turn {t}") for c in range(3) for t in range(300 - 100 * (c == 2))]  # two equal ones, and their beginning
    return rows + long + [(2000, None, None, None), (2000, 5, None, "x"), (2001, 3, "user", None), (None, 1, "user", "lost"), (2002, 1, "b", "tie"), (2002, 1, "a", "tie"), (2003, 0, "a", "z"), (2003, 0, "a", "z")]


@pytest.mark.parametrize("class_rows", [1, 8, 512])
def test_trie_against_all_prefixes(spark, class_rows):
    rows = made_conversations(class_rows)
    order = np.random.default_rng(0).permutation(len(rows))
    got = trie_rows(turntrie.conversation_trie(turns_of(spark, [rows[k] for k in order]), class_rows=class_rows))
    assert got == plain_trie(plain_turns(rows))


def test_rebuilt_conversations(spark, tmp_path):
    rows = made_conversations(7, 60) + [(-7, 0, "user", "same")]
    turns_of(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    own, rebuilt = plain_turns(rows), {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    assert [] in rebuilt.values()
    assert trie_rows(QUERIES["op12_prefix_trie"](spark, str(tmp_path))) == plain_trie(rebuilt)


def test_trie_of_nothing_and_of_one(spark):
    assert turntrie.conversation_trie(turns_of(spark, [])).collect() == []
    one = [(4, 0, "user", "hello")]
    assert trie_rows(turntrie.conversation_trie(turns_of(spark, one))) == plain_trie({4: [("user", "hello")]})


def test_ids_that_end_in_one_node_are_hashed_in_pieces(spark):
    ends = spark.range(30000).select(F.lit(1).cast("long").alias("cls"), F.lit(2).cast("long").alias("depth"), (F.col("id") - 9000).alias("conv"))
    r = turntrie.ends_hashes(ends.repartition(5)).collect()
    assert [(x.cls, x.depth, x.sha) for x in r] == [(1, 2, hashlib.sha256(",".join(str(k - 9000) for k in range(30000)).encode()).hexdigest())]


# 13 ranked search


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=50):
    held = [(d, Counter(plain_terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total, df = len(held), sum(c.total() for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        found = []
        for d, c in held:
            m = 100 - 50 + 50 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if t in c)
            found.append((-score, -(2**63) if d is None else d, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(x for x in found if x[0])[:k])]
    return Counter(out)


def search_rows(seed):
    rng = np.random.default_rng(seed)
    topics = [[f"t{t}w{k}" for k in range(120)] for t in range(6)]
    common = [f"c{k}" for k in range(30)]
    docs = []
    for i in range(400):
        own = topics[int(rng.integers(0, 6))]
        docs.append((i, " ".join(own[int(x * x * 120)] if y < 0.6 else common[int(x * 30)] for x, y in rng.random((int(rng.integers(3, 60)), 2)))))
    docs += [(k, docs[3][1]) for k in (500, 900, 901)] + [(7, "C1 c2\tÄb t0w3"), (7, "c1-c2_Äb"), (None, docs[5][1]), (800, None), (801, ""), (802, "-- !?"), (803, "c1 " * 20000 + "t1w1")]
    items = [(i, docs[int(rng.integers(0, 400))][1]) for i in range(12)] + [(20, "c1"), (20, "c1"), (20, "Äb"), (21, None), (22, "nothing known"), (23, "..."), (None, "t0w3 t0w3 c2")]
    return docs, items


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "item_id long, text string, item int, score int")


@pytest.mark.parametrize("options,search", [({}, {}), ({"shard_docs": 8, "max_levels": 5}, {}), ({"shard_docs": 16, "shard_postings": 60}, {"block_items": 5, "rounds": (1,)}), ({"shard_docs": 8, "sample_docs": 40, "buckets": 64}, {"rounds": (1, 4)})])
def test_search_against_all_documents(spark, options, search):
    docs, items = search_rows(len(options))
    index = lexical.build_index(docs_of(spark, docs), **options)
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(index, items_of(spark, items), k=7, **search).collect())
    assert got == plain_search(docs, items, 7)


def test_search_stops_before_shards_that_cannot_matter(spark):
    docs, items = search_rows(3)
    index = lexical.build_index(docs_of(spark, docs), shard_docs=8)
    visited, scores = [], lexical._scores

    def counted(*args):
        visited.append(args[2].copy())
        return scores(*args)

    lexical._scores = counted
    try:
        lexical.search(index, items_of(spark, items), k=5, rounds=(2, 6)).collect()
    finally:
        lexical._scores = scores
    assert len(visited) == 3 and (visited[1] > 0).any() and (visited[2] >= visited[1]).all()


def test_search_of_nothing(spark):
    some = items_of(spark, [(1, "a b")])
    assert lexical.search(lexical.build_index(docs_of(spark, [])), some).collect() == []
    assert lexical.search(lexical.build_index(docs_of(spark, [(1, None)])), some).collect() == []
    assert lexical.search(lexical.build_index(docs_of(spark, [(1, "a")])), items_of(spark, [])).collect() == []


def test_bisection_brings_like_documents_together():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, 12) + 40 * (i % 4)) for i in range(200)]
    leaf = lexical.bisect(sets, 2, 256).leaves(sets)
    groups = [Counter(leaf[np.arange(200) % 4 == t].tolist()) for t in range(4)]
    assert all(g.most_common(1)[0][1] >= 45 for g in groups) and len({g.most_common(1)[0][0] for g in groups}) == 4


def test_sets_as_bytes(spark):
    r = spark.createDataFrame([("A b c",), (None,)], "t string").select(similar.set_column(F.col("t"), 2).alias("s")).collect()
    assert [len(x.s) for x in r] == [16, 0]
