"""Approximate nearest neighbours by cosine with a forest of random-projection trees.

The trees are fitted on a bounded sample of the vectors; their inner nodes are
hyperplanes halfway between two random vectors' sides. Every vector is put into
one leaf of each tree. A query walks all trees at once with one priority queue,
in which a node's priority is the smallest margin on the way to it, until the
leaves it has reached hold enough vectors. Queries and vectors meet leaf by
leaf, where the cosines are computed exactly.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._common import bound_batches, stored

#: Vectors that trees are fitted on, at most: the first by a hash of their number.
SAMPLE_ROWS = 20_000
TREES = 16
#: Vectors of a leaf, about.
LEAF_ROWS = 256
#: Vectors that the leaves searched for a query hold (a vector counts in each tree): this many, and this share of all
#: leaves' vectors, at least. Vectors without structure need a share for a recall that doesn't fall with their number;
#: where vectors cluster, a share of 0 will do.
SEARCH_ROWS, SEARCH_SHARE = 8_000, 0.06
#: Vectors of a node that decide where it is split, at most.
SPLIT_ROWS = 256
#: Vectors that a block holds, about. A block has neighbouring leaves; larger leaves are split among blocks.
BLOCK_ROWS = 32_768
SEED = 20240506


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees in arrays. A child below 0 is the leaf -1 - child."""

    normal: np.ndarray
    offset: np.ndarray
    child: np.ndarray
    roots: np.ndarray
    n_leaves: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        while (inner := at >= 0).any():
            rows, trees = np.nonzero(inner)
            nodes = at[rows, trees]
            side = np.einsum("ij,ij->i", x[rows], self.normal[nodes]) > self.offset[nodes]
            at[rows, trees] = self.child[nodes, side.astype(np.int64)]
        return -1 - at

    def search(self, x: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
        """Leaves for one query, nearest first, until they hold ``wanted`` vectors."""
        queue = [(-math.inf, int(r)) for r in self.roots]
        heapq.heapify(queue)
        out, held = [], 0
        while queue and held < wanted:
            priority, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                held += int(sizes[-1 - node])
                continue
            margin = float(x @ self.normal[node] - self.offset[node])
            heapq.heappush(queue, (max(priority, -margin), int(self.child[node, 1])))
            heapq.heappush(queue, (max(priority, margin), int(self.child[node, 0])))
        return out


def fit_forest(x: np.ndarray, trees: int, leaf_rows: int, seed: int = SEED) -> Forest:
    """Trees over unit vectors; rows that no hyperplane parts share a leaf."""
    rng = np.random.Generator(np.random.PCG64(seed))
    normals, offsets, children, roots = [], [], [], []
    leaves = 0
    for _ in range(trees):
        roots.append(0)
        todo = [(np.arange(len(x)), len(roots) - 1, None)]
        while todo:
            rows, parent, side = todo.pop()
            split = _split(x[rows], rng) if len(rows) > leaf_rows else None
            if split is None:
                node = -1 - leaves
                leaves += 1
            else:
                node = len(normals)
                normals.append(split[0])
                offsets.append(split[1])
                children.append([0, 0])
                todo += [(rows[split[2]], node, 1), (rows[~split[2]], node, 0)]
            if side is None:
                roots[parent] = node
            else:
                children[parent][side] = node
    dim = x.shape[1]
    return Forest(
        np.array(normals).reshape(-1, dim), np.array(offsets, float), np.array(children, np.int64).reshape(-1, 2), np.array(roots, np.int64), leaves
    )


def _split(x: np.ndarray, rng: np.random.Generator):
    for _ in range(4):
        some = x[rng.choice(len(x), SPLIT_ROWS, replace=False)] if len(x) > SPLIT_ROWS else x
        a, b = some[rng.choice(len(some), 2, replace=False)]
        for _ in range(3):  # a few steps of 2-means
            near = some @ (a - b) > (a @ a - b @ b) / 2
            if not near.any() or near.all():
                break
            a, b = some[near].mean(axis=0), some[~near].mean(axis=0)
        normal = a - b
        length = np.linalg.norm(normal)
        if length < 1e-12:
            continue
        normal = normal / length
        value = x @ normal
        offset = float((a + b) @ normal / 2)
        near = value > offset
        if min(near.sum(), (~near).sum()) * 20 < len(x):  # lopsided: the median instead
            offset = float(np.median(value))
            near = value > offset
        if near.any() and not near.all():
            return normal, offset, near
    return None


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


FOUND = T.StructType(
    [T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())]
)


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    kind = vectors.schema[embedding].dataType
    values = F.col(embedding) if kind == T.ArrayType(T.FloatType(), kind.containsNull) else F.col(embedding).cast("array<double>")
    fine = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))) & F.exists(values, lambda v: v != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), values.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))
    )


def nearest(
    vectors: DataFrame,
    is_query,
    *,
    k: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    search_rows: int = SEARCH_ROWS,
    search_share: float = SEARCH_SHARE,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank (from 1), vec_id, score (the cosine).

    ``is_query`` is a condition on ``vec_id``; candidates are all rows with
    another number than the query's. Vectors that are null, empty, zero, hold
    null or non-finite components, lack a number, or have another length than
    most of the sample take no part. Ties go to the smaller number. A table
    without queries or vectors gives no rows; other columns are left out.

    Of equal vectors, only the k + 1 of smallest number can be among the
    nearest of a query, so only these are indexed. The driver holds the sample
    and the size of each leaf.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    usable = _usable(vectors, vec_id, embedding)
    first = Window.partitionBy("vector").orderBy("vec_id")
    distinct = stored(usable.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).drop("n"), "vectors")
    sample = [
        r[0] for r in distinct.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id", "vector").limit(sample_rows).select("vector").collect()
    ]
    if not sample:
        return spark.createDataFrame([], FOUND).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    lengths = np.array([len(v) for v in sample])
    dim = int(np.bincount(lengths).argmax())
    x = _unit(np.array([v for v in sample if len(v) == dim]))
    index = distinct.where(F.size("vector") == dim)
    rows = index.count()
    forest = fit_forest(x, trees, max(8, leaf_rows * len(x) // max(rows, 1)))

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = forest.leaves(_unit(_matrix(batch.column(1), dim)))
            take = pa.array(np.repeat(np.arange(batch.num_rows), at.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(at.ravel().astype(np.int32))], ["vec_id", "vector", "leaf"]
            )

    kinds = usable.schema.fields
    placed = index.mapInArrow(to_leaves, T.StructType([*kinds, T.StructField("leaf", T.IntegerType())]))
    counted = dict(placed.groupBy("leaf").count().collect())
    sizes = np.array([counted.get(i, 0) for i in range(forest.n_leaves)], np.int64)
    wanted = max(search_rows, math.ceil(search_share * sizes.sum()))
    # Blocks of neighbouring leaves; a leaf of more than BLOCK_ROWS has blocks of its own.
    first_block, n_blocks, block, held = [], [], 0, 0
    for size in sizes.tolist():
        parts = max(1, -(-size // BLOCK_ROWS))
        if held and (held + size > BLOCK_ROWS or parts > 1):
            block, held = block + 1, 0
        first_block.append(block)
        n_blocks.append(parts)
        block, held = (block + parts, 0) if parts > 1 else (block, held + size)
    first_of, parts_of = np.array(first_block), np.array(n_blocks)

    def to_searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, blocks, leaves = [], [], []
            for i, v in enumerate(_unit(_matrix(batch.column(1), dim))):
                by_block: dict[int, list[int]] = {}
                for leaf in forest.search(v, sizes, wanted):
                    for part in range(parts_of[leaf]):
                        by_block.setdefault(int(first_of[leaf]) + part, []).append(leaf)
                take += [i] * len(by_block)
                blocks += by_block.keys()
                leaves += by_block.values()
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(blocks, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))],
                ["vec_id", "vector", "block", "leaves"],
            )

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, ids = np.asarray(batch.column(2)), np.asarray(batch.column(0))
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            block = first_of[leaf] + (mixed % parts_of[leaf].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block.astype(np.int32))], ["vec_id", "vector", "leaf", "block"])

    def with_fields(*more: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([*kinds, *(T.StructField(n, t) for n, t in more)])

    queries = usable.where(F.size("vector") == dim).where(is_query)
    asked = queries.mapInArrow(to_searched, with_fields(("block", T.IntegerType()), ("leaves", T.ArrayType(T.IntegerType()))))
    given = placed.mapInArrow(to_blocks, with_fields(("leaf", T.IntegerType()), ("block", T.IntegerType())))
    met = (
        asked.select("block", F.lit(-1).alias("leaf"), "leaves", "vec_id", "vector")
        .unionByName(given.select("block", "leaf", F.lit(None).cast("array<int>").alias("leaves"), "vec_id", "vector"))
        .repartition("block")
        .sortWithinPartitions("block", "leaf")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams over blocks: a block's queries come first and are held, its vectors follow leaf by leaf."""
        home, ids, values, by_leaf, found = None, [], [], {}, []

        def best() -> pa.RecordBatch:
            a, b, c = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0), np.zeros(0), np.zeros(0))
            order = np.lexsort((b, -c, a))
            a, b, c = a[order].astype(np.int64), b[order].astype(np.int64), c[order].astype(np.float64)
            if len(a):  # a vector may have been met in several trees
                new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
                a, b, c = a[new], b[new], c[new]
                start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                rank = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
                a, b, c = a[rank < k], b[rank < k], c[rank < k]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["query_id", "vec_id", "score"])

        for batch in batches:
            blocks, leaf, numbers = (np.asarray(batch.column(i)) for i in (0, 1, 3))
            lists = batch.column(2)
            rows = _matrix(batch.column(4), dim)
            starts = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (leaf[1:] != leaf[:-1])])
            for start, stop in zip(starts, [*starts[1:], len(leaf)], strict=True):
                if home != blocks[start]:
                    if found:
                        yield best()
                    home, ids, values, by_leaf, found = blocks[start], [], [], {}, []
                if leaf[start] < 0:
                    for i in range(start, stop):
                        for x in lists[i].as_py():
                            by_leaf.setdefault(x, []).append(len(ids))
                        ids.append(numbers[i])
                        values.append(rows[i])
                elif at := by_leaf.get(int(leaf[start])):
                    if isinstance(ids, list):
                        ids, values = np.array(ids), np.array(values)
                    found.append(_best(ids[at], values[at], numbers[start:stop], rows[start:stop], k))
                    if sum(len(f[0]) for f in found) > 500_000:
                        done = best()
                        found = [tuple(np.asarray(done.column(i)) for i in range(3))]
        yield best()

    found = met.mapInArrow(compare, FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """Pairs that may be among the k nearest, with their exact cosines. Matrix products only choose; equal vectors get equal cosines."""
    a, b = _unit(queries), _unit(vectors)
    rows, columns = [], []
    for start in range(0, len(a), 1024):
        near = a[start : start + 1024] @ b.T
        near[query_ids[start : start + 1024, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            least = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k] - 1e-9
        else:
            least = np.full(len(near), -2.0)
        r, c = np.nonzero((near >= least[:, None]) & (near > -np.inf))
        rows.append(r + start)
        columns.append(c)
    r, c = np.concatenate(rows), np.concatenate(columns)
    q, v = queries[r], vectors[c]
    return query_ids[r], ids[c], cosine(q, v)


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (q * v).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))
