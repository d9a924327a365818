"""Text quality by a generalised additive model with pairwise interactions.

Cyclic boosting: round after round each feature gets one shallow tree (a few cuts over its bins) fit
to what is left of the logistic loss, shrunk and added to that feature's lookup table; then the best
feature pairs get depth-two trees over their joint bins in the same way.  A document's score is the
logistic function of an intercept plus one table entry a feature and a pair: vectorised bin
additions.

The model is fit on at most ``SAMPLE`` labelled documents, those of the smallest hash of doc_id (ties
by doc_id), a documented bound; features never see labels, lang, source or doc_id.

Cases: a null or empty text has all features zero and is scored like any other; a null doc_id is
never held out nor trained on; doubled label rows count once each; no labels, or labels of one class,
give a constant score; an empty table gives an empty result; input columns other than ``doc_id`` and
``text`` are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from .text import as_bytes
from .tokens import released, slices

SAMPLE = 20_000
BINS = 32
ROUNDS = 60
PAIR_ROUNDS = 30
PAIRS = 4
RATE = 0.25
CUTS = 3
THRESHOLD = 0.3
FEATURES = [
    "log_bytes", "log_words", "word_length", "long_words", "upper", "digits", "symbols", "pipes", "bangs",
    "stops", "other_ascii", "beyond_ascii", "distinct_words", "neighbours", "top_word", "distinct_lines", "line_words",
]
_CLASS = bytearray(256)
for _k, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>~^=+@", b"|", b"!", b".,;:?", b"\"'()[]{}/\\-_`"], 1):
    for _c in _chars:
        _CLASS[_c] = _k
for _c in range(128, 256):
    _CLASS[_c] = 8
_TABLE = bytes(_CLASS)
_BREAK = re.compile(rb"[\n]")


def text_features(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` a text."""
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    for r, t in enumerate(texts):
        words = t.split()
        n, m = len(words), max(1, len(t))
        if not n:
            continue
        kinds = np.bincount(np.frombuffer(t.translate(_TABLE), np.uint8), minlength=9) / m
        lengths = np.fromiter(map(len, words), np.int64, n)
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        lines = [x for x in t.split(b"\n") if x]
        same = sum(a == b for a, b in zip(words, words[1:]))
        out[r] = [
            np.log1p(len(t)), np.log1p(n), lengths.mean(), (lengths > 20).mean(), *kinds[1:6], kinds[6], kinds[7], kinds[8],
            len(counts) / n, same / n, max(counts.values()) / n, len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
        ]
    return out


def _cuts(gain: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Values a bin of a tree with ``CUTS`` cuts: greedily the split that lowers the loss most."""
    g, h = np.concatenate([[0], np.cumsum(gain)]), np.concatenate([[0], np.cumsum(weight)])
    edges = [0, len(gain)]
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    for _ in range(CUTS):
        best = max(
            ((worth(a, c) + worth(c, b) - worth(a, b), c) for a, b in zip(edges, edges[1:]) for c in range(a + 1, b)),
            default=(0, 0),
        )
        if best[0] <= 1e-9:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(gain))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


class Gam:
    """Bin edges a feature, a lookup table a feature, and a joint table a chosen pair."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        d = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for j in range(d)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.joint: list[np.ndarray] = []
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        if len(y) == 0 or y.min() == y.max():
            return
        b = self.bins(x)
        f = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for j in range(d):
                p = 1 / (1 + np.exp(-f))
                size = len(self.tables[j])
                step = RATE * _cuts(np.bincount(b[:, j], y - p, size), np.bincount(b[:, j], p * (1 - p), size))
                self.tables[j] += step
                f += step[b[:, j]]
        self._pairs(b, y, f)

    def _quad(self, b: np.ndarray, i: int, j: int, y: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray]:
        """The best depth-two tree over a pair: one cut of each feature, four values."""
        ni, nj = len(self.tables[i]), len(self.tables[j])
        at = b[:, i] * nj + b[:, j]
        g = np.bincount(at, y - p, ni * nj).reshape(ni, nj).cumsum(0).cumsum(1)
        h = np.bincount(at, p * (1 - p), ni * nj).reshape(ni, nj).cumsum(0).cumsum(1)
        if ni < 2 or nj < 2:
            return 0.0, np.zeros((ni, nj))
        quads = lambda s: (s[:-1, :-1], s[:-1, -1:] - s[:-1, :-1], s[-1:, :-1] - s[:-1, :-1], s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + s[:-1, :-1])
        gs, hs = quads(g), quads(h)
        worth = sum(a * a / (c + 1.0) for a, c in zip(gs, hs, strict=True))
        u, v = np.unravel_index(int(np.argmax(worth)), worth.shape)
        out = np.empty((ni, nj))
        vals = [a[u, v] / (c[u, v] + 1.0) for a, c in zip(gs, hs, strict=True)]
        out[: u + 1, : v + 1], out[: u + 1, v + 1 :], out[u + 1 :, : v + 1], out[u + 1 :, v + 1 :] = vals
        return float(worth[u, v]), out

    def _pairs(self, b: np.ndarray, y: np.ndarray, f: np.ndarray) -> None:
        p = 1 / (1 + np.exp(-f))
        d = b.shape[1]
        ranked = sorted(((-self._quad(b, i, j, y, p)[0], i, j) for i in range(d) for j in range(i)))
        self.pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
        self.joint = [np.zeros((len(self.tables[i]), len(self.tables[j]))) for i, j in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for k, (i, j) in enumerate(self.pairs):
                p = 1 / (1 + np.exp(-f))
                step = RATE * self._quad(b, i, j, y, p)[1]
                self.joint[k] += step
                f = f + step[b[:, i], b[:, j]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        f = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            f += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.joint, strict=True):
            f += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def held_out_col(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam:
    """The model of ``labels.quality`` from documents that are not held out."""
    usable = labels.where("quality is not null and doc_id is not null").where(~held_out_col(F.col("doc_id")))
    chosen = (
        usable.select("doc_id", F.col("quality").cast("double").alias("quality"))
        .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "quality").limit(sample).drop("h")
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` small rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(released(batches)):
            x = text_features(as_bytes(b.column("text")))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), flat], ["doc_id", "quality", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    got = rows.select("doc_id", "quality", "text").mapInArrow(features, f"doc_id {kind}, quality double, x array<float>").toArrow()
    y = got["quality"].to_numpy()
    x = np.array(got["x"].to_pylist(), np.float32).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T[::-1], y])
    return Gam(x[order], y[order])


def score_quality(docs: DataFrame, model: Gam, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all of them by default) and ``score``, the model's chance of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(released(batches)):
            s = shared.value.score(text_features(as_bytes(b.column("__text"))))
            keep = [c for c in b.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s, pa.float64())], [*keep, "score"])

    rest = [c for c in keep or docs.columns if c != "score"]
    src = docs.select(*rest, F.col("text").alias("__text"))
    fields = ", ".join(f"`{c}` {t}" for c, t in src.dtypes if c != "__text")
    return src.mapInArrow(score, f"{fields}, score double")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return score_quality(docs, model, ["doc_id"]).select(
        "doc_id",
        held_out_col(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
