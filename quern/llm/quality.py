"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics see the whole text and nothing else. Trees are grown on binned
statistics of a bounded sample of labelled documents, then flattened into
arrays; scoring walks all trees for a batch of documents with numpy.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._common import map_columns, without

#: Labelled documents that a fit looks at, at most: the first ones by a hash of their number.
MAX_LABELLED = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, MIN_ROWS = 80, 4, 64, 0.15, 1.0, 10

_GROUPS = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" \t\r\x0b\x0c",
    b"\n",
    b"!?",
    b"|",
    b"$%&*#@~^=+<>\\/_",
    b".,;:",
    b"'\"()[]{}-`",
    bytes(range(0x80, 0xC0)),  # all but the first byte of a character
    bytes(range(0xC0, 0x100)),
)
_GROUP_OF = np.full(256, len(_GROUPS), np.uint8)
for _i, _group in enumerate(_GROUPS):
    _GROUP_OF[list(_group)] = _i
N_STATISTICS = len(_GROUPS) + 1 + 11


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a text; null and empty texts give zeros."""
    out = np.zeros(N_STATISTICS)
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    k = len(_GROUPS) + 1
    out[:k] = np.bincount(_GROUP_OF[raw], minlength=k) / len(raw)
    words = text.split()
    lines = text.split("\n")
    n, m = len(words), len(lines)
    pairs = list(zip(words, words[1:]))
    out[k:] = (
        np.log1p(len(text)),
        np.log1p(n),
        len(text) / max(n, 1),
        len(set(words)) / max(n, 1),
        len(set(pairs)) / max(len(pairs), 1),
        sum(map(operator.eq, words, words[1:])) / max(len(pairs), 1),
        len(set(lines)) / m,
        np.log1p(len(text) / m),
        max(map(len, lines)) / len(text),
        max(map(len, words), default=0),
        sum(map(str.isupper, words)) / max(n, 1),
    )
    return out


@dataclass(frozen=True)
class Forest:
    """Complete binary trees in arrays: row t has the inner nodes of tree t level by level, and its leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of statistics."""
        trees = np.arange(len(self.leaf))
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(self.leaf.shape[1])) if len(trees) else 0):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        total = self.leaf[trees, node - self.feature.shape[1]].sum(axis=1) if len(trees) else 0.0
        return 1.0 / (1.0 + np.exp(-(self.base + total + np.zeros(len(x)))))


def grow(
    x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = RIDGE, min_rows: int = MIN_ROWS
) -> Forest:
    """Fit logistic loss by boosting. Without both labels, the forest has no trees and scores the share of ones (0.5 of no rows)."""
    inner = 2**depth - 1
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    none = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1))
    if len(y) == 0 or y.min() == y.max():
        return Forest(*none, base if len(y) else 0.0)
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    cell = binned + np.arange(f) * bins
    raw = np.full(n, base)
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            index = ((at - first)[:, None] * (f * bins) + cell).ravel()

            def histogram(weights: np.ndarray | None) -> np.ndarray:
                w = None if weights is None else np.repeat(weights, f)
                return np.bincount(index, w, minlength=width * f * bins).reshape(width, f, bins).cumsum(axis=2)

            g, h, c = histogram(grad), histogram(hess), histogram(None)
            all_g, all_h, all_c = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(c < min_rows) | (all_c - c < min_rows)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for node, b in enumerate(best):
                j, cut = divmod(int(b), bins)
                if gain[node, j, cut] > 1e-9 and cut < len(edges[j]):
                    feature[t, first + node], threshold[t, first + node] = j, edges[j][cut]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        at -= inner
        g = np.bincount(at, grad, minlength=inner + 1)
        h = np.bincount(at, hess, minlength=inner + 1)
        leaf[t] = rate * g / (h + ridge)
        raw += leaf[t, at]
    return Forest(feature, threshold, leaf, base)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, doc_id: str = "doc_id", max_rows: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that have a label 0 or 1: at most ``max_rows`` labels, the first by a hash of the number.

    The labels that are used are bounded by ``max_rows``, so they are broadcast.
    """
    used = (
        labels.select(F.col(doc_id).alias("labelled_id"), F.col(label).cast("int").alias("label_value"))
        .where("labelled_id is not null and label_value in (0, 1)")
        .orderBy(F.xxhash64(F.lit(7), "labelled_id"), "labelled_id", "label_value")
        .limit(max_rows)
    )
    return without(docs, ["labelled_id", "label_value"]).join(F.broadcast(used), F.col(doc_id) == F.col("labelled_id"))


def fit_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", text: str = "text", max_rows: int = MAX_LABELLED) -> Forest:
    """Fit on the labelled rows; the driver gets the statistics of ``max_rows`` documents at most."""
    sample = labelled_sample(docs, labels, label, max_rows=max_rows).select("labelled_id", "label_value", text)
    measured = (
        with_statistics(sample, text=text).orderBy("labelled_id", "label_value", "statistics").toPandas()
    )
    x = np.array(measured["statistics"].tolist(), dtype=float).reshape(len(measured), N_STATISTICS)
    return grow(x, measured["label_value"].to_numpy(dtype=float))


def with_statistics(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with its text replaced by its ``statistics`` (array<double>)."""

    def make():
        return lambda columns: [pa.array([statistics(t) for t in columns[0].to_pylist()], pa.list_(pa.float64()))]

    return map_columns(docs, [text], T.StructType([T.StructField("statistics", T.ArrayType(T.DoubleType()))]), make, drop=(text,))


def score_quality(docs: DataFrame, forest: Forest, *, text: str = "text", score: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` with the probability of label 1 (double). Null texts count as empty; an input column called ``score`` is replaced."""

    def make():
        def apply(columns: list[pa.Array]) -> list[pa.Array]:
            x = np.array([statistics(t) for t in columns[0].to_pylist()]).reshape(-1, N_STATISTICS)
            return [pa.array(forest.score(x), pa.float64())]

        return apply

    return map_columns(docs, [text], T.StructType([T.StructField(score, T.DoubleType())]), make, drop=() if keep_text else (text,))
