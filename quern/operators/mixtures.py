"""Gaussian mixtures: of single vectors with model selection, and of groups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def bic(log_likelihood: float, rows: int, parameters: int, weight: float = 1.0) -> float:
    """Log-likelihood less half of log2(rows) for each parameter; the larger the better."""
    return log_likelihood - 0.5 * np.log2(max(rows, 2)) * parameters * weight


def mixture_parameters(k: int, dims: int) -> int:
    return k - 1 + k * dims + k * dims * (dims + 1) // 2


def select_mixture(df: DataFrame, features: str, dims: int, ks: list[int], seed: int = 1) -> tuple[int, dict[int, float]]:
    """The number of components with the best criterion, and the criterion of each."""
    from pyspark.ml.clustering import GaussianMixture

    rows = df.count()
    out = {}
    for k in ks:
        model = GaussianMixture(featuresCol=features, k=k, seed=seed, maxIter=100, tol=1e-4).fit(df)
        out[k] = bic(model.summary.logLikelihood, rows, mixture_parameters(k, dims))
    return max(out, key=out.get), out


@dataclass
class GroupMixture:
    """Types of groups, each with its own shares of common Gaussian components."""

    types: np.ndarray  # T: how frequent the types are
    shares: np.ndarray  # T x K
    means: np.ndarray  # K x D
    covs: np.ndarray  # K x D x D

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Rows by components: logarithms of the Gaussian densities; covariances get a ridge where they need one."""
        out = np.empty((len(x), len(self.means)))
        d = x.shape[1]
        for k, (mean, cov) in enumerate(zip(self.means, self.covs, strict=True)):
            ridge = 1e-9 * max(np.trace(cov) / d, 1e-9)
            while True:
                try:
                    low = np.linalg.cholesky(cov + ridge * np.eye(d))
                    break
                except np.linalg.LinAlgError:
                    ridge *= 10
            z = np.linalg.solve(low, (x - mean).T)
            out[:, k] = -0.5 * ((z * z).sum(axis=0) + d * np.log(2 * np.pi)) - np.log(np.diag(low)).sum()
        return out

    def of_group(self, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """A group's log-likelihood, the chances of its types, and its rows' chances of components."""
        dens = self.log_density(x)
        with np.errstate(divide="ignore"):
            joint = dens[:, None, :] + np.log(self.shares)[None]  # rows, types, components
            by_row = _logsum(joint, 2)
            by_type = by_row.sum(axis=0) + np.log(self.types)
        total = float(_logsum(by_type[None], 1)[0])
        chance = np.exp(by_type - total)
        rows = np.einsum("t,rtk->rk", chance, np.exp(joint - by_row[:, :, None]))
        return total, chance, rows


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


def _groups(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[object, np.ndarray]]:
    """Groups from batches sorted by their first column."""
    name, parts = None, []
    for batch in batches:
        keys = batch.column(0).to_pylist()
        x = np.asarray(batch.column(1).flatten(), float).reshape(-1, dims)
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if parts and keys[start] != name:
                    yield name, np.concatenate(parts)
                    parts = []
                name = keys[start]
                parts.append(x[start:i])
                start = i
    if parts:
        yield name, np.concatenate(parts)


def fit_group_mixture(df: DataFrame, group: str, vector: str, dims: int, types: int, components: int, steps: int = 20, seed: int = 0) -> GroupMixture:
    """Expectation maximisation. Groups stay in their partitions; each step sends the driver sums of a fixed size.

    A group must fit in one task.
    """
    rows = df.select(F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("v")).repartition("g").sortWithinPartitions("g").persist()
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64(F.lit(seed), "g", "v")).limit(2000).select("v").collect()])
    rng = np.random.default_rng(seed)
    means = sample[[rng.integers(len(sample))]]
    while len(means) < components:  # far from those chosen
        far = ((sample[:, None] - means[None]) ** 2).sum(axis=2).min(axis=1)
        means = np.vstack([means, sample[rng.choice(len(sample), p=far / far.sum()) if far.sum() else rng.integers(len(sample))]])
    spread = np.cov(sample.T).reshape(dims, dims) / components + 1e-6 * np.eye(dims)
    model = GroupMixture(np.full(types, 1 / types), rng.dirichlet(np.ones(components) * 2, types), means, np.repeat(spread[None], components, axis=0))
    shape = [types, types * components, components, components * dims, components * dims * dims]
    ends = np.cumsum(shape)
    for _ in range(steps):
        now = model

        def partial(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(ends[-1])
            for _, x in _groups(batches, dims):
                _, chance, own = now.of_group(x)
                dens = now.log_density(x)
                with np.errstate(divide="ignore"):
                    joint = dens[:, None, :] + np.log(now.shares)[None]
                share = np.exp(joint - _logsum(joint, 2)[:, :, None]).sum(axis=0) * chance[:, None]
                second = np.einsum("rk,ri,rj->kij", own, x, x)
                sums += np.concatenate([chance, share.ravel(), own.sum(axis=0), (own.T @ x).ravel(), second.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["cell", "value"])

        got = np.zeros(ends[-1])
        for cell, value in rows.mapInArrow(partial, "cell long, value double").groupBy("cell").agg(F.sum("value")).collect():
            got[cell] = value
        a, b, c, d, e = np.split(got, ends[:-1])
        share = b.reshape(types, components) + 1e-9
        weight = np.maximum(c, 1e-9)
        means = d.reshape(components, dims) / weight[:, None]
        covs = e.reshape(components, dims, dims) / weight[:, None, None] - np.einsum("ki,kj->kij", means, means) + 1e-6 * np.eye(dims)
        model = GroupMixture((a + 1e-9) / (a + 1e-9).sum(), share / share.sum(axis=1, keepdims=True), means, covs)
    rows.unpersist()
    return model


def score_groups(df: DataFrame, group: str, vector: str, dims: int, model: GroupMixture) -> DataFrame:
    """group, rows, ll: the log-likelihood of each group; the lower by row, the odder."""
    kind, arrow = df.schema[group].dataType.simpleString(), to_arrow_type(df.schema[group].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [(g, len(x), model.of_group(x)[0]) for g, x in _groups(batches, dims)]
        g, n, ll = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(g, arrow), pa.array(n, pa.int64()), pa.array(ll, pa.float64())], ["g", "rows", "ll"])

    rows = df.select(F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("v")).repartition("g").sortWithinPartitions("g")
    return rows.mapInArrow(run, f"g {kind}, rows long, ll double").withColumnRenamed("g", group)
