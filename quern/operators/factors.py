"""Matrix factorisations. Matrices that fit in one process are numpy arrays; tall ones are DataFrames of row vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def truncated_svd(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k leading singular triplets, through the smaller of the two Gram matrices where that is much smaller."""
    m, n = x.shape
    k = min(k, m, n)
    if min(m, n) * 4 > max(m, n):
        u, s, vt = np.linalg.svd(x, full_matrices=False)
        return u[:, :k], s[:k], vt[:k]
    if m < n:
        u, s, vt = truncated_svd(x.T, k)
        return vt.T, s, u.T
    values, vectors = np.linalg.eigh(x.T @ x)
    v = vectors[:, np.argsort(values)[::-1][:k]]
    s = np.linalg.norm(x @ v, axis=0)
    return x @ v / np.where(s > 0, s, 1), s, v.T


def shrink(x: np.ndarray, t: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - t, 0)


def robust_pca(x: np.ndarray, weight: float = 1.0, tolerance: float = 1e-7, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Low-rank and sparse parts of ``x``, by the inexact augmented Lagrangian method."""
    lam = weight / np.sqrt(max(x.shape))
    norm2, size = np.linalg.norm(x, 2), np.linalg.norm(x)
    if size == 0:
        return np.zeros_like(x), np.zeros_like(x)
    y = x / max(norm2, np.abs(x).max() / lam)
    mu, low, sparse = 1.25 / norm2, np.zeros_like(x), np.zeros_like(x)
    ceiling = mu * 1e7
    for _ in range(steps):
        u, s, vt = np.linalg.svd(x - sparse + y / mu, full_matrices=False)
        low = (u * np.maximum(s - 1 / mu, 0)) @ vt
        sparse = shrink(x - low + y / mu, lam / mu)
        gap = x - low - sparse
        y, mu = y + mu * gap, min(mu * 1.5, ceiling)
        if np.linalg.norm(gap) / size < tolerance:
            break
    return low, sparse


def direct_robust_factorisation(x: np.ndarray, rank: int, outliers: float, steps: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of the given rank and at most a share of outlier cells: the largest residuals are set aside, the rest fitted, in turn."""
    aside, before = np.zeros_like(x), np.inf
    kept = int(outliers * x.size)
    low = np.zeros_like(x)
    for _ in range(steps):
        u, s, vt = truncated_svd(x - aside, rank)
        low = (u * s) @ vt
        gap = x - low
        aside = np.zeros_like(x)
        if kept:
            cut = np.partition(np.abs(gap).ravel(), x.size - kept)[x.size - kept]
            aside = np.where(np.abs(gap) >= cut, gap, 0)
        now = np.linalg.norm(gap - aside)
        if abs(before - now) <= tolerance * max(1.0, now):
            break
        before = now
    return low, aside


def alternating_least_squares(x: np.ndarray, rank: int, steps: int = 20, ridge: float = 1e-6, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """U (rank x m) and V (rank x n) with x near U' V."""
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((rank, x.shape[1]))
    eye = ridge * np.eye(rank)
    for _ in range(steps):
        u = np.linalg.solve(v @ v.T + eye, v @ x.T)
        v = np.linalg.solve(u @ u.T + eye, u @ x)
    return u, v


def nonnegative_factors(x: np.ndarray, rank: int, steps: int = 50, seed: int = 0, floor: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Nonnegative U and V with x near U' V: one row of one factor at a time is solved for, and held above ``floor``."""
    rng = np.random.default_rng(seed)
    u, v = rng.random((rank, x.shape[0])) + floor, rng.random((rank, x.shape[1])) + floor
    for _ in range(steps):
        for a, b, target in ((u, v, x), (v, u, x.T)):
            gram, cross = b @ b.T, b @ target.T
            for r in range(rank):
                a[r] = np.maximum(a[r] + (cross[r] - gram[r] @ a) / max(gram[r, r], floor), floor)
    return u, v


def svd_factors(x: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """U and V with x near U' V, the singular values shared by both."""
    u, s, vt = truncated_svd(x, rank)
    root = np.sqrt(s)
    return (u * root).T, vt * root[:, None]


class OnlineFactors:
    """A dictionary learned from batches of rows: sufficient statistics of the coefficients are kept, rows aren't."""

    def __init__(self, rank: int, dims: int, ridge: float = 1e-3, seed: int = 0):
        self.d = np.random.default_rng(seed).standard_normal((rank, dims))
        self.a, self.b, self.ridge = np.zeros((rank, rank)), np.zeros((rank, dims)), ridge

    def coefficients(self, x: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.d @ self.d.T + self.ridge * np.eye(len(self.d)), self.d @ x.T).T

    def update(self, x: np.ndarray) -> None:
        c = self.coefficients(x)
        self.add(c.T @ c, c.T @ x)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Take in a batch by its sums of products of coefficients with one another and with the rows."""
        self.a, self.b = self.a + a, self.b + b
        self.d = np.linalg.solve(self.a + self.ridge * np.eye(len(self.a)), self.b)


def sketched_svd(df: DataFrame, vector: str, dims: int, k: int, extra: int = 8, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Leading singular values and right vectors of the rows in ``df``, from a random projection.

    Two passes: the first adds up the product of the Gram matrix with random
    columns, the second that with their orthonormal basis. The driver gets
    ``dims`` times ``k + extra`` numbers from each.
    """
    width = min(dims, k + extra)

    def gram_times(columns: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(columns.shape)
            for batch in batches:
                x = np.asarray(batch.column(0).flatten(), float).reshape(-1, dims)
                out += x.T @ (x @ columns)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["cell", "value"])

        rows = df.select(F.col(vector).cast("array<double>")).mapInArrow(partial, "cell long, value double").groupBy("cell").agg(F.sum("value")).collect()
        out = np.zeros(columns.size)
        for cell, value in rows:
            out[cell] = value
        return out.reshape(columns.shape)

    start = np.random.default_rng(seed).standard_normal((dims, width))
    basis = np.linalg.qr(gram_times(start))[0]
    small = basis.T @ gram_times(basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:k]
    return np.sqrt(np.maximum(values[order], 0)), (basis @ vectors[:, order]).T


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns matched at the least total cost; a matrix that isn't square is padded with its largest cost.

    Shortest augmenting paths with potentials.
    """
    cost = np.asarray(cost, float)
    m, n = cost.shape
    size = max(m, n)
    full = np.full((size + 1, size + 1), cost.max() if cost.size else 0.0)
    full[1 : m + 1, 1 : n + 1] = cost
    left, right = np.zeros(size + 1), np.zeros(size + 1)
    owner = np.zeros(size + 1, int)
    for row in range(1, size + 1):
        owner[0], column = row, 0
        slack, came = np.full(size + 1, np.inf), np.zeros(size + 1, int)
        done = np.zeros(size + 1, bool)
        while True:
            done[column] = True
            reduced = full[owner[column]] - left[owner[column]] - right
            better = ~done & (reduced < slack)
            better[0] = False
            slack[better], came[better] = reduced[better], column
            open_slack = np.where(done, np.inf, slack)
            open_slack[0] = np.inf
            nearest = int(open_slack.argmin())
            step = open_slack[nearest]
            left[owner[done]] += step
            right[done] -= step
            slack[~done] -= step
            column = nearest
            if owner[column] == 0:
                break
        while column:
            owner[column] = owner[came[column]]
            column = came[column]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, size + 1) if owner[j] <= m and j <= n)
