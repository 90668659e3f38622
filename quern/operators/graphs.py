"""Edges, adjacency, connected components and clusters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.shared import stored

#: Edges that one task may join into components; it holds two numbers for each.
SMALL_EDGES = 250_000


def undirected(edges: DataFrame, src: str, dst: str, position: str) -> DataFrame:
    """Edges without loops, each undirected one once, at its first position: a, b, pos."""
    return (
        edges.where(F.col(src) != F.col(dst))
        .groupBy(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
        .agg(F.min(position).alias("pos"))
    )


def adjacency(edges: DataFrame, src: str, dst: str, weight: str) -> DataFrame:
    """One weight for each pair; repeated edges add up."""
    return edges.groupBy(src, dst).agg(F.sum(weight).alias(weight))


def neighbour_lists(edges: DataFrame, src: str, dst: str, dist: str) -> DataFrame:
    """For each node its neighbours by distance."""
    return edges.groupBy(src).agg(F.sort_array(F.collect_list(F.struct(F.col(dist).alias("dist"), F.col(dst).alias("dst")))).alias("near"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges (u, v): each number that isn't the least of its component, and that one."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = sorted((root(u), root(v)))
            if a != b:
                above[b] = a
    found = [(x, root(x)) for x in list(above)]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["id", "root"])


def component_roots(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``id`` and ``root``, the least number that edges lead to, of all numbers that have edges to others and aren't roots.

    Up to SMALL_EDGES edges are joined by one task. More are joined by large
    and small stars in turn, by all tasks: each node's neighbours above it, then those
    below, are hung onto its least neighbour, until nothing changes. The number
    of rounds grows with the logarithm of a component's diameter.
    """
    now = stored(edges.select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")).where("u <> v").distinct(), "stars")
    if now.count() <= SMALL_EDGES:
        return now.coalesce(1).mapInArrow(_joined, "id long, root long")
    before = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(hung.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "stars")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = mark


def connected_components(vertices: DataFrame, edges: DataFrame, vid: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    """``vid`` and ``component``, the least number that edges lead to, of all vertices."""
    roots = component_roots(edges, src, dst).select(F.col("id").alias("u"), "root")
    return vertices.join(roots, F.col(vid) == F.col("u"), "left").select(vid, F.coalesce("root", vid).alias("component"))


def sized(components: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """Members of components with at least and at most so many."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    kept = sizes.where((F.col("size") >= least) & (F.lit(True) if most is None else F.col("size") <= most))
    return components.join(kept, "component")
