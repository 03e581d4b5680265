"""Toxicity from class-conditional Kneser-Ney bigram models of words.

Two models, of toxic and of ordinary texts. The highest order counts bigrams, the order below counts in how many
contexts a word comes, and the lowest order is shared: the continuations that both classes have of a word. A bigram's or
word's count is lowered by an absolute discount, n1 / (n1 + 2 n2) of its order, and what is freed goes to the order
below. A place counts once for all copies: of equal runs of five words in a class one is counted, so copied texts,
passages and lines weigh as one. Words that are rarer than `min_count` and a share of the documents become the longest
beginning that rare words share often enough, or one rare word that both models give the same chance; bigrams of
less than `min_pair` places are left to the lower order. So rare expressions are smoothed by counts they share.

A text's log-likelihoods are compared per word, over the whole text and over its STANDING most toxic words that are not
the same, as a few words make a long text toxic; a logistic curve turns both into a score. It is fitted by folds: every
text of the sample is scored by counts of the other folds, and the model then counts all of them.

The models are fitted on a bounded sample: `sample_docs` documents of either class, those with the smallest hash of
their id, one row of each, as far as they have `sample_bytes` bytes in all. Counting happens in one task over that sample alone.

Defined results: a null or empty text, or one without words, scores as a text whose words say nothing; very long texts are scored whole; labels that contradict each other count as toxic; null labels
and null ids are not learned from; of rows that repeat an id, one is learned from and all are scored; without labels of
both classes every score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import may_learn, smallest_hashes

_WORD = re.compile(r"[^\W_]+")
STANDING = 3
#: Scores from here on mean toxic.
THRESHOLD = 0.3
#: Lengths of the beginnings that stand for rare words, longest first.
BEGINNINGS = (8, 7, 6, 5, 4)
#: Ids of a text's beginning and of a rare word; words and beginnings follow.
START, RARE = 0, 1


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class ToxicModel:
    """known: ids of words and (with a trailing blank) of beginnings; gain: log ratio of an id's lower orders; after: log ratio of
    the mass that an id as context leaves to them; pair, pair_gain: bigrams (first * size + second, sorted) with a ratio of their own."""

    known: dict[str, int] = field(default_factory=dict)
    size: int = 2
    gain: np.ndarray = field(default_factory=lambda: np.zeros(2))
    after: np.ndarray = field(default_factory=lambda: np.zeros(2))
    pair: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pair_gain: np.ndarray = field(default_factory=lambda: np.zeros(0))
    curve: tuple[float, float, float] | None = None
    memo: dict[str, int] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def id_of(self, word: str) -> int:
        return self.known.get(word) or next((i for n in BEGINNINGS if n <= len(word) and (i := self.known.get(word[:n] + " "))), RARE)

    def ids(self, found: list[str]) -> np.ndarray:
        ids = np.fromiter(map(self.memo.get, found, repeat(-1)), np.int64, len(found))
        for k in np.flatnonzero(ids < 0).tolist():
            ids[k] = self.id_of(found[k])
            if len(self.memo) < 1_000_000:  # looked up anew beyond that
                self.memo[found[k]] = int(ids[k])
        return ids

    def ratios(self, found: list[str]) -> np.ndarray:
        """Log ratio of both models for each word after the word before it."""
        ids = np.concatenate([[START], self.ids(found)])
        ratio = self.gain[ids[1:]] + self.after[ids[:-1]]
        if len(self.pair):
            key = ids[:-1] * self.size + ids[1:]
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            hit = self.pair[at] == key
            ratio[hit] = self.pair_gain[at[hit]]
        return ratio

    def features(self, text: str | None) -> tuple[float, float]:
        """Log ratio per word of the most toxic words that are not the same (where it is above 0), and of the whole text."""
        found = words(text)
        if not found:
            return 0.0, 0.0
        ratio, best = self.ratios(found), {}
        for k in np.argsort(-ratio, kind="stable").tolist():
            if len(best) == STANDING or ratio[k] <= 0:
                break
            best.setdefault(found[k], float(ratio[k]))
        return sum(best.values()) / STANDING, float(ratio.mean())

    def score(self, text: str | None) -> float:
        if self.curve is None:
            return 0.0
        standing, whole = self.features(text)
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * (standing - whole) + b * whole + c, -30, 30))))


def places(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First and second id of the bigrams of a class; of places with equal words two before to two after, one."""
    if not any(len(r) for r in rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = np.zeros(2, np.int64)
    flat = np.concatenate([x for r in rows for x in (gap, r)] + [gap])
    mixed = np.zeros(len(flat) - 4, np.uint64)
    for k in range(5):
        mixed = (mixed ^ flat[k : len(flat) - 4 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    at = np.unique(mixed, return_index=True)[1] + 2
    at = at[flat[at] > 0]
    return flat[at - 1], flat[at]


def discount(counts: np.ndarray) -> float:
    """Kneser-Ney's estimate from the numbers of expressions that came once and twice."""
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(once / (once + 2 * twice)) if once else 0.5


def _name_ids(number: dict[str, int], often: np.ndarray, least: float) -> tuple[dict[str, int], np.ndarray, int]:
    """Ids of words that come `least` times and of beginnings that rarer words share as often; the new id of each old one; how many there are."""
    new, known, size = np.full(len(often), RARE), {}, 2
    new[0] = START
    rare = []
    for w, i in number.items():
        if often[i] >= least:
            known[w] = new[i] = size
            size += 1
        else:
            rare.append((w, i))
    for n in BEGINNINGS:
        held = Counter()
        for w, i in rare:
            if len(w) >= n:
                held[w[:n]] += int(often[i])
        rest = []
        for w, i in rare:
            if len(w) >= n and held[w[:n]] >= least:
                if w[:n] + " " not in known:
                    known[w[:n] + " "] = size
                    size += 1
                new[i] = known[w[:n] + " "]
            else:
                rest.append((w, i))
        rare = rest
    return known, new, size


def _counted(coded: tuple[list[np.ndarray], list[np.ndarray]], number: dict[str, int], min_count: float, min_share: float, min_pair: int) -> ToxicModel:
    """The two models of texts given as old ids of words, without a curve."""
    least = max(min_count, min_share * min(map(len, coded)))
    raw = [places(rows) for rows in coded]
    often = sum(np.bincount(w, minlength=len(number) + 1) for _, w in raw)
    known, new, m = _name_ids(number, often, least)

    sides = [np.unique(new[v] * m + new[w], return_counts=True) for v, w in raw]
    pairs = np.union1d(sides[0][0], sides[1][0])
    count = np.zeros((2, len(pairs)))
    for x in (0, 1):
        count[x][np.searchsorted(pairs, sides[x][0])] = sides[x][1]
    contexts = np.stack([np.bincount(pairs[c > 0] % m, minlength=m) for c in count]).astype(float)
    shared = contexts.min(axis=0) + 1
    shared[START] = 0
    shared /= shared.sum()
    word = np.ones((2, m))
    for x in (0, 1):
        own = np.maximum(contexts[x] - discount(contexts[x]), 0) / max(contexts[x].sum(), 1)
        word[x] = own + (1 - own.sum()) * shared
    word[:, START] = word[:, RARE] = 1.0  # nothing is asked of the one, and both models know as little of the other
    total = np.stack([np.bincount(pairs // m, weights=c, minlength=m) for c in count])
    kept = np.flatnonzero((count.sum(axis=0) >= min_pair) & (pairs % m != RARE))
    v, w = pairs[kept] // m, pairs[kept] % m
    own = np.stack([np.maximum(c[kept] - discount(c), 0) / np.maximum(total[x][v], 1) for x, c in enumerate(count)])
    freed = np.maximum(1 - np.stack([np.bincount(v, weights=o, minlength=m) for o in own]), 1e-9)
    both = own + freed[:, v] * word[:, w]
    return ToxicModel(known, m, np.log(word[1] / word[0]), np.log(freed[1] / freed[0]), pairs[kept], np.log(both[1] / both[0]))


def _curve(features: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """A logistic curve over how far the most toxic words stand out, and over the whole text; even odds score THRESHOLD."""
    z, y = np.column_stack([features[:, 0] - features[:, 1], features[:, 1], np.ones(len(features))]), toxic.astype(float)
    weight = np.where(y == 1, THRESHOLD / max(y.sum(), 1), (1 - THRESHOLD) / max((1 - y).sum(), 1))
    scale = np.maximum(np.abs(z).max(axis=0), 1e-6)
    z, beta = z / scale, np.zeros(3)
    for _ in range(40):  # Newton steps with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (p - y)) + 1e-5 * beta
        beta -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-5 * np.eye(3), grad)
    return tuple((beta / scale).tolist())


def fit_models(texts: list[str], toxic: list[bool], min_count: float = 12, min_share: float = 0.02, min_pair: int = 12, folds: int = 4) -> ToxicModel:
    """Counts from all texts, with a ratio of their own for bigrams that come `min_pair` times; the curve from texts that are scored by the counts of the other folds."""
    number: dict[str, int] = {}
    coded = [np.array([number.setdefault(w, len(number) + 1) for w in words(t)], np.int64) for t in texts]
    side, fold, seen = np.array(list(map(int, toxic)), np.int64), np.zeros(len(texts), np.int64), [0, 0]
    for i, x in enumerate(side.tolist()):
        fold[i], seen[x] = seen[x] % folds, seen[x] + 1
    if not all(seen):
        return ToxicModel()
    counted = lambda at: _counted(tuple([coded[i] for i in np.flatnonzero(at & (side == x))] for x in (0, 1)), number, min_count, min_share, min_pair)
    model, found = counted(side >= 0), np.zeros((len(texts), 2))
    for k in range(folds):
        held, rest = fold == k, fold != k
        judge = counted(rest) if {*side[rest].tolist()} == {0, 1} else model  # a class of one text
        for i in np.flatnonzero(held).tolist():
            found[i] = judge.features(texts[i])
    model.curve = _curve(found, side)
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample_docs: int = 4096, sample_bytes: int = 1 << 28, **options) -> ToxicModel:
    """A model from labelled documents that are not held out; at most `sample_docs` of either class are used, one row of each, and half of
    `sample_bytes` of either (of a class, the first text in any case)."""
    marked = labels.filter(F.col(label).isNotNull() & may_learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("__toxic"))
    marked = marked.filter(F.col("__toxic").isin(0, 1))
    there = docs.select(F.col(doc_id).alias("doc_id"))
    chosen = smallest_hashes(marked.join(there, "doc_id", "left_semi"), "__toxic", "doc_id", sample_docs)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # 2 * sample_docs ids at most
    rows = rows.groupBy("doc_id", "__toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("row"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["__toxic"].to_pylist())), key=lambda r: r[0])
        model = fit_models([r[1] for r in got], [bool(r[2]) for r in got], **options)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # The sample is bounded, so one task can take it; only the model comes to the driver.
    order = Window.partitionBy("__toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    upto = F.sum(F.octet_length("row.text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__nth", F.row_number().over(order)).withColumn("__upto", upto).filter((F.col("__upto") <= sample_bytes // 2) | (F.col("__nth") == 1))
    fitted = rows.select("doc_id", F.col("row.text").alias("text"), "__toxic").repartition(1).mapInArrow(fit, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else ToxicModel()


def toxicity_score(model: ToxicModel, text: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(text)
