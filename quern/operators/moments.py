"""Means, covariances and column scaling, and principal components made from them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shift and scale of a column in each mode, as aggregates.
_COLUMN_MODES = {
    "01": lambda c: (F.min(c), F.max(c) - F.min(c)),
    "pm1": lambda c: ((F.max(c) + F.min(c)) / 2, (F.max(c) - F.min(c)) / 2),
    "s1": lambda c: (F.lit(0.0), F.sum(c)),
    "m0": lambda c: (F.avg(c), F.lit(1.0)),
    "v1": lambda c: (F.lit(0.0), F.stddev_samp(c)),
    "n1": lambda c: (F.lit(0.0), F.sqrt(F.sum(F.col(c).cast("double") * F.col(c)))),
    "m0v1": lambda c: (F.avg(c), F.stddev_samp(c)),
}


def column_scaling(df: DataFrame, columns: list[str], mode: str) -> DataFrame:
    """One row with the shift and scale of each column, to be used on other rows too; a scale of zero is 1."""
    parts = []
    for c in columns:
        shift, scale = _COLUMN_MODES[mode](c)
        parts += [shift.alias(f"{c}__shift"), F.when(scale != 0, scale).otherwise(F.lit(1.0)).alias(f"{c}__scale")]
    return df.agg(*parts)


def apply_scaling(df: DataFrame, columns: list[str], scaling: DataFrame) -> DataFrame:
    scaled = {c: (F.col(c) - F.col(f"{c}__shift")) / F.col(f"{c}__scale") for c in columns}
    return df.crossJoin(F.broadcast(scaling)).withColumns(scaled).select(*df.columns)


def normalize_columns(df: DataFrame, columns: list[str], mode: str) -> DataFrame:
    return apply_scaling(df, columns, column_scaling(df, columns, mode))


def covariance_long(df: DataFrame, vector: str, dims: int, weight: Column | None = None, ridge: float = 0.0) -> DataFrame:
    """i, j, cov of the first ``dims`` components: population covariance, weighted if asked, with ``ridge`` on the diagonal.

    All sums are plain aggregates of one pass.
    """
    w = F.lit(1.0) if weight is None else weight
    x = [F.col(vector)[i] for i in range(dims)]
    sums = [F.sum(w).alias("n")] + [F.sum(w * x[i]).alias(f"s{i}") for i in range(dims)]
    sums += [F.sum(w * x[i] * x[j]).alias(f"q{i}_{j}") for i in range(dims) for j in range(i, dims)]
    cells = []
    for i in range(dims):
        for j in range(dims):
            a, b = min(i, j), max(i, j)
            cov = F.col(f"q{a}_{b}") / F.col("n") - F.col(f"s{a}") * F.col(f"s{b}") / (F.col("n") * F.col("n"))
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (cov + (ridge if i == j else 0.0)).alias("cov")))
    return df.agg(*sums).select(F.inline(F.array(*cells)))


def moments(df: DataFrame, vector: str, dims: int, weight: Column | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean and population covariance of all vectors without nulls and NaN; weighted if asked, with the sum of weights.

    Each task sums blocks with numpy; partial sums are added cell by cell, so
    the driver gets dims * dims numbers.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), float).reshape(-1, dims)
            whole = ~np.isnan(x).any(axis=1)
            x, w = x[whole], np.asarray(batch.column(1), float)[whole]
            n, s, q = n + w.sum(), s + w @ x, q + (x * w[:, None]).T @ x
        cells = np.concatenate([[n], s, q.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "value"])

    v = F.col(vector).cast("array<double>")
    w = F.lit(1.0) if weight is None else weight
    whole = df.select(v.alias("v"), w.alias("w")).where((F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull()) & F.col("w").isNotNull())
    rows = whole.mapInArrow(partial, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    cells = np.zeros(1 + dims + dims * dims)
    for row in rows:
        cells[row[0]] = row[1]
    n = cells[0] or 1
    mean = cells[1 : dims + 1] / n
    return cells[0] if weight is not None else int(cells[0]), mean, cells[dims + 1 :].reshape(dims, dims) / n - np.outer(mean, mean)


def effective_rank(eigen: np.ndarray, energy: float) -> int:
    """How many of the largest eigenvalues hold the share ``energy``, all at most."""
    ordered = np.sort(np.maximum(eigen, 0))[::-1]
    if not ordered.sum():
        return min(1, len(ordered))
    return min(int((np.cumsum(ordered) / ordered.sum() <= energy).sum()) + 1, len(ordered))


@dataclass(frozen=True)
class Components:
    mean: np.ndarray
    basis: np.ndarray  # a column for each component kept
    eigen: np.ndarray  # all, descending

    @property
    def rank(self) -> int:
        return self.basis.shape[1]


def principal_components(df: DataFrame, vector: str, dims: int, energy: float = 0.99) -> Components:
    _, mean, cov = moments(df, vector, dims)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(dims)] < 0, -1, 1)
    return Components(mean, vectors[:, : effective_rank(values, energy)], values)


def anomaly_scores(x: np.ndarray, model: Components) -> dict[str, np.ndarray]:
    """Reconstruction error, the same weighted by component, Mahalanobis distance, and distances outside of the kept space."""
    centred = x - model.mean
    kept = centred @ model.basis
    rec = ((centred - kept @ model.basis.T) ** 2).sum(axis=1)
    energy = np.maximum(model.eigen, 1e-12)
    left = (centred**2).sum(axis=1)[:, None] - np.cumsum(kept**2, axis=1)
    return {
        "rec_err": rec,
        "accum_err": np.maximum(left, 0).sum(axis=1) + rec,
        "dist": (kept**2 / energy[: model.rank]).sum(axis=1),
        "dist_out": rec / max(energy[model.rank :].sum(), 1e-12) if model.rank < len(energy) else np.zeros(len(x)),
    }


def score_anomalies(df: DataFrame, key: str, vector: str, model: Components) -> DataFrame:
    names = ["rec_err", "accum_err", "dist", "dist_out"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), float).reshape(-1, len(model.mean))
            got = anomaly_scores(x, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[n]) for n in names)], [key, *names])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} double" for n in names))
