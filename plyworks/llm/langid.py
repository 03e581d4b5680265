"""Language identification with a small byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths run over a window, the largest response of each filter goes to a softmax
over the languages. A text is cut into windows of `WINDOW` bytes (the last one is padded); the text's answer is the
mean over all its windows, weighted by their length.

Training takes a bounded sample: `sample_docs` documents of each language (`sample_total` over all), those with the
smallest hash of their id, and of each one `windows_per_doc` excerpts at hashed places. One task trains on that sample.

Defined results: a null text or one without a letter is `und` with score 0; without labelled rows all texts are `und`;
null languages are not learned; of rows that repeat an id and a language one is learned from, all are scored one by one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import may_learn, smallest_hashes

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
DIMS = 6
UNKNOWN = "und"


@dataclass
class ByteConvNet:
    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 5) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        w = {"embed": rng.normal(0, 0.5, (256, DIMS))}
        for k in WIDTHS:
            w[f"f{k}"], w[f"b{k}"] = rng.normal(0, (k * DIMS) ** -0.5, (k * DIMS, FILTERS)), np.zeros(FILTERS)
        w["out"], w["bias"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), np.zeros(len(languages))
        return cls(languages, {n: x.astype(np.float32) for n, x in w.items()})

    def _columns(self, windows: np.ndarray, k: int) -> np.ndarray:
        """(windows, places, k * DIMS): what the filters of width k see at each place."""
        e = self.weights["embed"][windows]
        return np.lib.stride_tricks.sliding_window_view(e.reshape(len(e), -1), k * DIMS, axis=1)[:, ::DIMS]

    def forward(self, windows: np.ndarray):
        w, peaks, where = self.weights, [], []
        for k in WIDTHS:
            seen = np.ascontiguousarray(self._columns(windows, k))
            act = (seen.reshape(-1, k * DIMS) @ w[f"f{k}"]).reshape(*seen.shape[:2], FILTERS)
            at = act.argmax(axis=1)
            where.append(at)
            peaks.append(np.maximum(np.take_along_axis(act, at[:, None], axis=1)[:, 0] + w[f"b{k}"], 0))
        hidden = np.concatenate(peaks, axis=1)
        z = hidden @ w["out"] + w["bias"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), hidden, where

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax outputs of windows (uint8). All filters run as one of the greatest width, filled up with zeros."""
        w, most = self.weights, max(WIDTHS)
        kernel = np.concatenate([np.pad(w[f"f{k}"], ((0, (most - k) * DIMS), (0, 0))) for k in WIDTHS], axis=1)
        e = w["embed"][windows].reshape(len(windows), -1)
        e = np.concatenate([e, np.zeros((len(e), (most - min(WIDTHS)) * DIMS), np.float32)], axis=1)
        seen = np.lib.stride_tricks.sliding_window_view(e, most * DIMS, axis=1)[:, ::DIMS]
        act = (seen.reshape(-1, most * DIMS) @ kernel).reshape(*seen.shape[:2], -1)
        peak = act[:, : WINDOW - most + 1].max(axis=1)
        for n, k in enumerate(WIDTHS):  # the last places, which only narrower filters have
            own = slice(n * FILTERS, (n + 1) * FILTERS)
            if k < most:
                peak[:, own] = np.maximum(peak[:, own], act[:, WINDOW - most + 1 : WINDOW - k + 1, own].max(axis=1))
        z = np.maximum(peak + np.concatenate([w[f"b{k}"] for k in WIDTHS]), 0) @ w["out"] + w["bias"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        p, hidden, where = self.forward(windows)
        dz = p
        dz[np.arange(len(p)), target] -= 1
        dz /= len(p)
        g = {"out": hidden.T @ dz, "bias": dz.sum(axis=0), "embed": np.zeros_like(w["embed"])}
        dh = (dz @ w["out"].T) * (hidden > 0)
        for n, k in enumerate(WIDTHS):
            d = dh[:, n * FILTERS : (n + 1) * FILTERS]
            places = where[n][:, :, None] + np.arange(k)  # the bytes under each filter's peak
            seen = windows[np.arange(len(windows))[:, None, None], places]
            under = w["embed"][seen].reshape(len(windows), FILTERS, k * DIMS)
            g[f"f{k}"], g[f"b{k}"] = np.einsum("nfc,nf->cf", under, d), d.sum(axis=0)
            back = (d[:, :, None] * w[f"f{k}"].T[None]).reshape(len(windows), FILTERS, k, DIMS)
            np.add.at(g["embed"], seen.ravel(), back.reshape(-1, DIMS))
        return g

    def fit(self, windows: np.ndarray, target: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 4e-3, seed: int = 6) -> ByteConvNet:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        m = {n: np.zeros_like(x) for n, x in self.weights.items()}
        v = {n: np.zeros_like(x) for n, x in self.weights.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                step += 1
                for n, g in self.gradients(windows[order[at : at + batch]], target[order[at : at + batch]]).items():
                    m[n] += 0.1 * (g - m[n])
                    v[n] += 0.01 * (g * g - v[n])
                    self.weights[n] -= (rate * 0.8**epoch * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def languages_of(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """The language of each text and its mean probability over all windows."""
        counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
        total = np.zeros((len(texts), len(self.languages)))
        owner, at = np.repeat(np.arange(len(texts)), counts), 0
        flat = np.frombuffer(b"".join(t.ljust(n * WINDOW, b" ") for t, n in zip(texts, counts.tolist())), np.uint8).reshape(-1, WINDOW)
        size = np.full(len(flat), float(WINDOW))
        size[np.cumsum(counts) - 1] = [max(1, len(t) - (n - 1) * WINDOW) for t, n in zip(texts, counts.tolist())]
        for at in range(0, len(flat), 48):
            part = slice(at, at + 48)
            np.add.at(total, owner[part], self.probabilities(flat[part]) * size[part, None])
        mean = total / total.sum(axis=1, keepdims=True)
        best = mean.argmax(axis=1)
        return [self.languages[b] for b in best], mean[np.arange(len(mean)), best].clip(0, 1).tolist()


def window_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass")[:WINDOW].ljust(WINDOW, b" "), np.uint8)


def fit_languages(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = 800, sample_total: int = 32_000, windows_per_doc: int = 3) -> ByteConvNet | None:
    """A network from labelled documents that are not held out; None if there are none.

    At most `sample_docs` documents of each language are used, and fewer where languages are so many that all would be over `sample_total`."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & may_learn(F.col("doc_id"))).filter(F.col("text").rlike(r"\p{L}"))
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    places = [F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit(k)), room).cast("int") + 1, F.lit(WINDOW)).alias(f"w{k}") for k in range(windows_per_doc)]
    rows = rows.select("doc_id", "lang", *places)
    sample = smallest_hashes(rows, "lang", "doc_id", sample_docs, sample_total)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(tuple(r.values()) for b in batches for r in b.to_pylist())
        languages = sorted({r[1] for r in got})
        excerpts = [(window_of(r[2 + k]), languages.index(r[1])) for k in range(windows_per_doc) for r in got]
        net = ByteConvNet.fresh(languages).fit(np.stack([w for w, _ in excerpts]), np.array([x for _, x in excerpts])) if got else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    # The sample is bounded, so one task can take it; only the network comes to the driver.
    fitted = sample.select("doc_id", "lang", *[f"w{k}" for k in range(windows_per_doc)]).repartition(1).mapInArrow(fit, "net binary").first()
    return pickle.loads(fitted["net"]) if fitted else None


def predict_language(net: ByteConvNet | None, text: Column) -> Column:
    """struct(lang_pred, score) of a text."""

    @F.pandas_udf(T.StructType().add("lang_pred", T.StringType()).add("score", T.DoubleType()))
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = {"lang_pred": [], "score": []}
        held, size = [], 0

        def flush():
            nonlocal held, size
            names, scores = net.languages_of(held)
            out["lang_pred"] += names
            out["score"] += scores
            held, size = [], 0

        for t in texts:
            held.append(t.encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            if size > 1 << 20:
                flush()
        if held:
            flush()
        return pd.DataFrame(out)

    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if net is None:
        return none
    worded = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return F.when(worded, predict(F.coalesce(text, F.lit("")))).otherwise(none)
