"""Nearest-neighbour, radius and box joins."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import graphs
from quern.operators.graphs import component_roots
from quern.shared import stored

#: Rows of a block of the pool, and of the queries that meet it.
BLOCK_ROWS = 8_192

#: Rows of a cell whose lists of neighbours one group makes, and pairs that it compares at a time (or those of one row).
LIST_ROWS, PAIRS = 512, 1 << 19

#: Rows of a cell that one group of a grid join takes; a merge join holds as many at a time.
PART_ROWS = 2_048

#: Rows of a list that ``box_join`` takes apart at once; the pairs of a list and a part wait in memory.
NEAR_ROWS = 64

#: Rows of a bucket's part in ``approximate_neighbours``.
BUCKET_ROWS = 8_192


def exact_neighbours(queries: DataFrame, pool: DataFrame, key: str, vector: str, k: int, *, include_self: bool = True) -> DataFrame:
    """src, dst, dist: the ``k`` nearest of the pool to each query by Euclidean distance; ties to the smaller key.

    Both sides are cut into blocks by a hash of the key, and each pair of
    blocks is compared with one matrix product; the k best of each block are
    then ranked over all. Exact, and quadratic: for large pools in few
    dimensions use ``radius_join``.
    """
    cut = lambda df, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    p, q = (max(1, math.ceil(df.count() / BLOCK_ROWS)) for df in (pool, queries))
    kind = f"array<{pool.schema[vector].dataType.elementType.simpleString()}>"
    pool_rows = pool.select(cut(pool, p).alias("pb"), F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("qb"), F.lit(1).alias("side"), F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))
    query_rows = queries.select(F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("pb"), cut(queries, q).alias("qb"), F.lit(0).alias("side"), F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))
    met = query_rows.unionByName(pool_rows)

    def best(table: pa.Table) -> pa.Table:
        side, ids = np.asarray(table["side"]), np.asarray(table["id"])
        x = np.array(table["v"].to_pylist(), dtype=float)
        a, b = x[side == 0], x[side == 1]
        ia, ib = ids[side == 0], ids[side == 1]
        if not len(a) or not len(b):
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        square = np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)
        if not include_self:
            square[ia[:, None] == ib[None, :]] = np.inf
        if len(ib) > k:
            least = np.partition(square, k - 1, axis=1)[:, k - 1] + 1e-9
        else:
            least = np.full(len(a), np.inf)
        r, c = np.nonzero((square <= least[:, None]) & np.isfinite(square))
        exact = np.sqrt(((a[r] - b[c]) ** 2).sum(axis=1))
        return pa.table({"src": ia[r], "dst": ib[c], "dist": exact})

    found = met.groupBy("pb", "qb").applyInArrow(best, "src long, dst long, dist double")
    # Rounded for the order alone, so that equal distances are ties on every machine.
    order = Window.partitionBy("src").orderBy(F.round("dist", 9), "dst")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _cells(columns: dict[str, float]) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(float(size))).cast("long") for c, size in columns.items()]


def _placed(df: DataFrame, key: str, columns: dict[str, float], side: str, grid: list[str]) -> DataFrame:
    """Key and columns as ``side``_*, beside the cell in ``grid``; without rows whose numbers are missing or infinite, which are near to nothing."""
    # A hair wider, for the rounding of differences.
    cells = _cells({c: size * (1 + 1e-9) for c, size in columns.items()})
    finite = df.where(" and ".join(f"abs(`{c}`) < double('infinity')" for c in columns))
    return finite.select(F.col(key).alias(f"{side}_id"), *(F.col(c).alias(f"{side}_{c}") for c in columns), *(c.alias(g) for c, g in zip(cells, grid, strict=True)))


def _grid_pairs(left: DataFrame, right: DataFrame, key: str, columns: dict[str, float]) -> DataFrame:
    """Pairs of rows of either in the same or a neighbouring cell of a grid; columns a_* and b_*.

    Parts of a cell's rows, of about PART_ROWS each, meet all rows around it. Rows are dealt to
    tasks by cell and part: a small file would else be broadcast and met by the one task
    that reads the other side, however many pairs there are.
    """
    names, grid = list(columns), [f"g{i}" for i in range(len(columns))]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here, there = _placed(left, key, columns, "a", grid), _placed(right, key, columns, "b", grid).repartition("b_id")
    cells = here.groupBy(*grid).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts"))
    here = here.join(cells, grid).withColumn("part", F.pmod(F.xxhash64("a_id", *(f"a_{c}" for c in names)), "parts")).drop("parts")
    for g in grid:
        there = there.withColumn(g, F.explode(F.array(F.col(g) - 1, F.col(g), F.col(g) + 1)))
    there = there.join(cells, grid).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    met = [*grid, "part"]
    return there.repartition(tasks, *met).join(here.repartition(tasks, *met).hint("merge"), met)


def radius_join(df: DataFrame, key: str, columns: list[str], radius: float) -> DataFrame:
    """src, dst, dist of all rows within the radius of each other, a row itself included.

    Rows meet by grid cell: an equi-join on cells of the radius's size, in which
    one side stands in its 3 ** d neighbouring cells.
    """
    return radius_pairs(df, df, key, columns, radius)


def radius_pairs(left: DataFrame, right: DataFrame, key: str, columns: list[str], radius: float) -> DataFrame:
    """src of ``left``, dst of ``right`` and dist of all rows within the radius of each other."""
    pairs = _grid_pairs(left, right, key, dict.fromkeys(columns, radius))
    square = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in columns), F.lit(0.0))
    return pairs.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), square.alias("square")).where(F.col("square") <= radius * radius).select(
        "src", "dst", F.sqrt("square").alias("dist")
    )


def label_distances(df: DataFrame, label: str, columns: list[str], radius: float) -> DataFrame:
    """a, b, dist: for the labels of two rows within the radius, the sum of all such distances, a row's own 0 included.

    The sums of ``radius_join`` without its pairs as rows: a cell's rows and
    those of its neighbouring cells meet in parts of about BLOCK_ROWS, whose
    distances are summed in numpy.
    """
    grid = [f"g{i}" for i in range(len(columns))]
    rows = df.select(F.col(label).alias("label"), *(F.col(c).cast("double").alias(c) for c in columns), *(x.alias(g) for x, g in zip(_cells(dict.fromkeys(columns, radius)), grid, strict=True)))
    rows = rows.where(" and ".join(f"{g} is not null" for g in grid))
    around = rows
    for g in grid:
        around = around.withColumn(g, F.explode(F.array(F.col(g) - 1, F.col(g), F.col(g) + 1)))
    parts = lambda x, name: x.groupBy(*grid).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias(name))
    cells = stored(parts(rows, "mine").join(parts(around, "others"), grid), "cells")
    place = F.xxhash64("label", *columns, F.monotonically_increasing_id())
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    here = rows.withColumn("place", place).join(cells, grid).select(*grid, F.pmod("place", "mine").alias("own"), every("others").alias("other"), F.lit(0).alias("side"), "label", *columns)
    there = around.withColumn("place", place).join(cells, grid).select(*grid, every("mine").alias("own"), F.pmod("place", "others").alias("other"), F.lit(1).alias("side"), "label", *columns)

    def sums(table: pa.Table) -> pa.Table:
        side = np.asarray(table["side"])
        coded = table["label"].combine_chunks().dictionary_encode(null_encoding="encode")
        code, n = np.asarray(coded.indices).astype(np.int64), len(coded.dictionary)
        x = np.column_stack([np.asarray(table[c]) for c in columns])
        a, b, of_a, of_b = x[side == 0], x[side == 1], code[side == 0], code[side == 1]
        found: dict[int, float] = {}
        for low in range(0, len(a), 128):
            square = 0.0
            for k in range(len(columns)):
                d = a[low : low + 128, k, None] - b[None, :, k]
                square = square + d * d
            r, c = np.nonzero(square <= radius * radius)
            name, dist = of_a[low + r] * n + of_b[c], np.sqrt(square[r, c])
            if n * n > len(name):
                names, name = np.unique(name, return_inverse=True)
            else:
                names = np.arange(n * n)
            total, many = np.bincount(name, dist, len(names)), np.bincount(name, minlength=len(names))
            for i in np.flatnonzero(many).tolist():
                found[int(names[i])] = found.get(int(names[i]), 0.0) + float(total[i])
        pick = lambda f: coded.dictionary.take(pa.array([f(name) for name in found], pa.int64()))
        return pa.table({"a": pick(lambda v: v // n), "b": pick(lambda v: v % n), "dist": pa.array(list(found.values()), pa.float64())})

    kind = df.schema[label].dataType.simpleString()
    summed = here.unionByName(there).groupBy(*grid, "own", "other").applyInArrow(sums, f"a {kind}, b {kind}, dist double")
    return summed.groupBy("a", "b").agg(F.sum("dist").alias("dist"))


def radius_lists(df: DataFrame, key: str, columns: list[str], radius: float) -> DataFrame:
    """src and near, the keys of all rows within the radius, itself included, by distance to 9 places and key.

    The lists of ``radius_join`` without its pairs as rows: parts of a cell's
    rows meet all rows of the neighbouring cells, so that a row's whole list is
    found and sorted in one place. Only rows that share a key, whose lists are
    one, go by pairs. Missing and infinite numbers are near to nothing.
    """
    grid = [f"g{i}" for i in range(len(columns))]
    df = df.where(" and ".join(f"abs(`{c}`) < double('infinity')" for c in columns))
    rows = df.select(F.col(key).alias("id"), *(F.col(c).cast("double").alias(c) for c in columns), *(x.alias(g) for x, g in zip(_cells(dict.fromkeys(columns, radius * (1 + 1e-9))), grid, strict=True)))
    rows = rows.where(" and ".join(f"{g} is not null" for g in grid))
    rows = stored(rows.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("id"))), "points")
    alone = rows.where("same = 1")
    around = rows.select("id", *columns, *grid)
    for g in grid:
        around = around.withColumn(g, F.explode(F.array(F.col(g) - 1, F.col(g), F.col(g) + 1)))
    cells = alone.groupBy(*grid).agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).alias("parts"))
    here = alone.join(cells, grid).select(*grid, F.pmod(F.xxhash64("id"), "parts").alias("part"), F.lit(0).alias("side"), "id", *columns)
    there = around.join(cells, grid).select(*grid, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "id", *columns)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        side = np.asarray(table["side"])
        ids = table["id"].combine_chunks()
        x = np.column_stack([np.asarray(table[c]) for c in columns])
        at = np.asarray(pc.array_sort_indices(ids, null_placement="at_start"))
        at = at[side[at] == 1]
        a, b, src, dst = x[side == 0], x[at], ids.filter(pa.array(side == 0)), ids.take(pa.array(at))
        width = max(1, len(b).bit_length())
        step = max(1, PAIRS // max(1, len(b)))
        for low in range(0, len(a), step):
            square = 0.0
            for k in range(len(columns)):
                d = a[low : low + step, k, None] - b[None, :, k]
                square = square + d * d
            r, c = np.nonzero(square <= radius * radius)
            t = np.sqrt(square[r, c]) * 1e9
            floor = np.floor(t)
            floor += t - floor >= 0.5
            n = min(step, len(a) - low)
            if int(floor.max(initial=0)).bit_length() + width + n.bit_length() < 63:
                bits = int(floor.max(initial=0)).bit_length()
                order = (r << (bits + width)) | (floor.astype(np.int64) << width) | c
                order.sort()
                c = order & ((1 << width) - 1)
            else:
                c = c[np.lexsort((c, floor, r))]
            ends = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))])
            found = ends[1:] > ends[:-1]
            near = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), dst.take(pa.array(c)))
            yield pa.RecordBatch.from_arrays([src.slice(low, n), near], ["src", "near"]).filter(pa.array(found))

    kind = df.schema[key].dataType.simpleString()
    found = here.unionByName(there).groupBy(*grid, "part").applyInArrow(lists, f"src {kind}, near array<{kind}>")
    edges = radius_pairs(rows.where("same > 1"), rows, "id", columns, radius)
    shared = graphs.neighbour_lists(edges.withColumn("dist", F.round("dist", 9)), "src", "dst", "dist")
    return found.unionByName(shared.select("src", F.transform("near", lambda n: n["dst"]).alias("near")))


def box_join(df: DataFrame, key: str, half: dict[str, float]) -> DataFrame:
    """src, dst of all rows that differ by at most ``half`` in each column.

    As in ``radius_join`` parts of a cell's rows meet all rows around it, but the
    latter in lists of about NEAR_ROWS: one step of the join meets a row with a
    whole list, which is then taken apart beside it.
    """
    names, grid = list(half), [f"g{i}" for i in range(len(half))]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _placed(df, key, half, "a", grid)
    number = lambda size, name: F.ceil(F.count(F.lit(1)) / size).alias(name)
    cells = rows.groupBy(*grid).agg(number(PART_ROWS, "parts"), number(NEAR_ROWS, "lists"))
    place = F.xxhash64("a_id", *(f"a_{c}" for c in names))
    rows = rows.join(cells, grid).withColumns({"part": F.pmod(place, "parts"), "list": F.pmod(place, "lists")}).drop("parts", "lists")
    near = F.struct(F.col("a_id").alias("b_id"), *(F.col(f"a_{c}").alias(f"b_{c}") for c in names))
    there = rows.groupBy(*grid, "list").agg(F.collect_list(near).alias("near")).drop("list")
    for g in grid:
        there = there.withColumn(g, F.explode(F.array(F.col(g) - 1, F.col(g), F.col(g) + 1)))
    there = there.join(cells.drop("lists"), grid).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    met = [*grid, "part"]
    here = rows.drop("list").repartition(tasks, *met)
    pairs = there.repartition(tasks, *met).join(here.hint("merge"), met).select("a_id", *(f"a_{c}" for c in names), F.inline("near"))
    for c, h in half.items():
        pairs = pairs.where(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= h)
    return pairs.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))


def neighbour_scores(edges: DataFrame, k: int, src: str = "src", dist: str = "dist") -> DataFrame:
    """Anomaly of each source: its mean distance, with the row itself counted in K at distance 0, and its largest."""
    return edges.groupBy(src).agg((F.sum(dist) / k).alias("mean_dist"), F.max(dist).alias("max_dist"))


def _square(a, b, columns: list[str]):
    return sum(((a[c] - b[c]) * (a[c] - b[c]) for c in columns), F.lit(0.0))


def near_components(df: DataFrame, key: str, columns: list[str], radius: float) -> DataFrame:
    """``key`` and ``component``, the least key that steps between rows within the radius lead to, of all rows.

    The same as the connected components of ``radius_join``, without its pairs:
    all rows of a grid cell whose diagonal is below the radius hang together, so
    that cells are joined, not rows. Two cells are linked at once if extreme
    rows of theirs are within the radius. Only cells that then don't hang
    together and have more rows are compared row by row, those rows that are
    within the radius of the other cell's bounds. Keys are numbers; rows with a
    missing or infinite coordinate are alone. Coordinates may reach 1e9 radii.
    """
    side = radius / math.sqrt(len(columns)) * (1 - 1e-6)
    most = radius * radius
    grid = [f"g{i}" for i in range(len(columns))]
    finite = F.lit(True)
    for c in columns:
        finite = finite & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    rows = df.select(F.col(key).alias("id"), *(F.when(finite, F.col(c).cast("double")).alias(c) for c in columns))
    rows = rows.select("*", *(x.alias(g) for x, g in zip(_cells(dict.fromkeys(columns, side)), grid, strict=True)))
    whole = rows.where(F.col(grid[0]).isNotNull())
    at = F.struct(*columns)
    found = whole.groupBy(*grid).agg(
        F.min("id").alias("cell"), F.count(F.lit(1)).alias("n"),
        F.array_distinct(F.array(*(f(at, F.col(c)) for c in columns for f in (F.min_by, F.max_by)))).alias("ends"),
        F.struct(*(F.min(c).alias(c) for c in columns)).alias("low"), F.struct(*(F.max(c).alias(c) for c in columns)).alias("high"),
    )
    cells = stored(found, "cells")
    reach = math.ceil(math.sqrt(len(columns)) * (1 + 1e-5))
    steps = [s for s in itertools.product(range(-reach, reach + 1), repeat=len(columns)) if s > (0,) * len(columns)]
    step = F.explode(F.array(*(F.struct(*(F.lit(x).cast("long").alias(g) for g, x in zip(grid, s, strict=True))) for s in steps)))
    left = cells.select(*grid, F.struct("cell", "n", "ends", "low", "high").alias("a"))
    right = cells.select("*", step.alias("step")).select(*((F.col(g) + F.col(f"step.{g}")).alias(g) for g in grid), F.struct("cell", "n", "ends", "low", "high").alias("b"))
    pairs = left.join(right, grid).select("a", "b")
    apart = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a.low.{c}") - F.col(f"b.high.{c}"), F.col(f"b.low.{c}") - F.col(f"a.high.{c}")), 2) for c in columns), F.lit(0.0))
    near = F.exists("a.ends", lambda p: F.exists("b.ends", lambda q: _square(p, q, columns) <= most))
    more = (F.col("a.n") > F.size("a.ends")) | (F.col("b.n") > F.size("b.ends"))
    # A hair wider, for the rounding of powers.
    pairs = pairs.where(apart <= most * (1 + 1e-9)).select("a", "b", near.alias("near")).where(F.col("near") | more)
    pairs = stored(pairs, "cell-pairs")
    edges = pairs.where("near").select(F.col("a.cell").alias("src"), F.col("b.cell").alias("dst"))
    placed = whole.join(cells.select(*grid, "cell"), grid)
    # Rows that share a key hang together wherever they are.
    again = placed.groupBy("id").agg(F.min("cell").alias("dst"), F.max("cell").alias("last")).where("dst <> last").select("id", "dst")
    edges = stored(edges.unionByName(placed.join(again, "id").select(F.col("cell").alias("src"), "dst")), "cell-links")
    roots = component_roots(edges)
    root = lambda x: roots.select(F.col("id").alias(f"{x}_id"), F.col("root").alias(f"{x}_root"))
    open_pairs = pairs.where("not near").join(root("a"), F.col("a.cell") == F.col("a_id"), "left").join(root("b"), F.col("b.cell") == F.col("b_id"), "left")
    open_pairs = open_pairs.where(F.coalesce("a_root", "a.cell") != F.coalesce("b_root", "b.cell"))
    sides = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(f"{x}.cell").alias("cell"), F.col(f"{y}.low"), F.col(f"{y}.high")) for k, (x, y) in enumerate(("ab", "ba")))))
    meet = stored(open_pairs.select(F.col("a.cell").alias("src"), F.col("b.cell").alias("dst"), sides.alias("of")).select("src", "dst", "of.*"), "open-cells")
    if meet.take(1):
        off = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"low.{c}") - F.col(c), F.col(c) - F.col(f"high.{c}")), 2) for c in columns), F.lit(0.0))
        met = placed.join(meet, "cell").where(off <= most * (1 + 1e-9)).select("src", "dst", "side", *columns).distinct()

        def linked(table: pa.Table) -> pa.Table:
            some = np.asarray(table["side"])
            x = np.column_stack([np.asarray(table[c]) for c in columns])
            a, b = x[some == 0], x[some == 1]
            a, b = a[np.argsort(a[:, 0])], b[np.argsort(b[:, 0])]
            return table.select(["src", "dst"]).slice(0, int(len(a) > 0 and len(b) > 0 and _any_within(a, b, radius)))

        kind = df.schema[key].dataType.simpleString()
        edges = edges.unionByName(met.groupBy("src", "dst").applyInArrow(linked, f"src {kind}, dst {kind}"))
        roots = component_roots(edges)
    of_cell = cells.join(roots, F.col("cell") == F.col("id"), "left").select(*grid, F.coalesce("root", "cell").alias("component"))
    return rows.join(of_cell, grid, "left").select(F.col("id").alias(key), F.coalesce("component", "id").alias("component"))


def _any_within(a: np.ndarray, b: np.ndarray, radius: float, block: int = 256) -> bool:
    """Whether a row of ``a`` is within the radius of one of ``b``, both sorted by their first column."""
    for i in range(0, len(a), block):
        some = a[i : i + block]
        low, high = some[0, 0] - 2 * radius, some[-1, 0] + 2 * radius
        first, last = np.searchsorted(b[:, 0], low), np.searchsorted(b[:, 0], high, side="right")
        for j in range(first, last, block):
            other = b[j : min(j + block, last)]
            square = 0.0
            for k in range(a.shape[1]):
                d = some[:, k, None] - other[None, :, k]
                square = square + d * d
            if (square <= radius * radius).any():
                return True
    return False


def greedy_thin(df: DataFrame, key: str, columns: list[str], radius: float) -> DataFrame:
    """Rows but those that have an earlier one in their group of rows within the radius: one of each, the least key.

    Groups are connected components, so what stays doesn't depend on the order
    in which rows are looked at.
    """
    groups = near_components(df, key, columns, radius)
    return df.join(groups.where(F.col(key) == F.col("component")).select(key), key, "left_semi")


def approximate_neighbours(df: DataFrame, key: str, vector: str, radius: float, bucket: float = 0.5, tables: int = 6, seed: int = 1) -> DataFrame:
    """src, dst, dist below the radius, as far as random-projection buckets find them.

    The pairs of ``approxSimilarityJoin``, without its candidates as rows: parts
    of a table's bucket meet two by two and are compared with one matrix product;
    a pair is given by the first table in which its rows share a bucket. No
    bucket is cut; rows whose buckets hold most of the table make it quadratic.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x")).distinct().withColumn("vector", array_to_vector("x"))
    model = BucketedRandomProjectionLSH(inputCol="vector", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(rows)
    hashes = F.array(*(vector_to_array(F.col("h")[i])[0].cast("long") for i in range(tables)))
    hashed = stored(model.transform(rows).select("id", "x", hashes.alias("h")), "buckets")
    dealt = hashed.select("*", F.posexplode("h").alias("t", "bucket"))
    parts = dealt.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).alias("parts"))
    part = F.pmod(F.xxhash64("id", "x"), "parts").alias("part")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    dealt = dealt.join(parts, ["t", "bucket"]).select("t", "bucket", "id", "x", "h", "parts", part).select("*", other)
    met = dealt.select("t", "bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"), "id", "x", "h")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        table = table.take(pa.array(np.argsort(np.asarray(table["side"]), kind="stable"))).combine_chunks()
        ids, first = table["id"].combine_chunks(), int((np.asarray(table["side"]) == 0).sum())
        x, h = (np.asarray(pc.list_flatten(table[c])).reshape(table.num_rows, -1) for c in ("x", "h"))
        alone, before = table["i"][0] == table["j"][0], table["t"][0].as_py()
        start, square, one = 0 if alone else first, (x * x).sum(axis=1), np.ones(len(x))
        # What rounding of the products may add; the distance itself decides.
        slack = [4 * (x.shape[1] + 6) * float(np.finfo(kind).eps) * float(square.max()) for kind in (np.float32, float)]
        kind, most = (np.float32, radius * radius + slack[0]) if slack[0] <= 0.1 * radius * radius else (float, radius * radius + slack[1])
        a, b = np.column_stack([x, square, one]).astype(kind), np.column_stack([-2 * x, one, square]).astype(kind)
        for mine, others, low in _unmet(h[:, :before], first, start, alone):
            r, c = np.nonzero(a[mine] @ b[others].T <= most)
            r, c = mine[r], others[c]
            if low:
                r, c = r[r <= c], c[r <= c]
            fresh = ~(h[r, :before] == h[c, :before]).any(axis=1)
            r, c = r[fresh], c[fresh]
            dist = np.concatenate([np.sqrt(((x[r[k : k + 4096]] - x[c[k : k + 4096]]) ** 2).sum(axis=1)) for k in range(0, len(r), 4096)] or [np.zeros(0)])
            kept = dist < radius
            r, c, dist = r[kept], c[kept], dist[kept]
            two = r != c
            src, dst = ids.take(pa.array(np.concatenate([r, c[two]]))), ids.take(pa.array(np.concatenate([c, r[two]])))
            yield pa.RecordBatch.from_arrays([src, dst, pa.array(np.concatenate([dist, dist[two]]))], ["src", "dst", "dist"])

    kind, tasks = df.schema[key].dataType.simpleString(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ["t", "bucket", "i", "j"]
    return met.repartition(tasks, *group).groupBy(*group).applyInArrow(near, f"src {kind}, dst {kind}, dist double")


def _unmet(before: np.ndarray, first: int, start: int, alone: bool, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows up to ``first``, rows from ``start`` to compare them with, and whether pairs occur in both orders.

    ``before`` has the rows' hashes in earlier tables; if these are few, rows that share one are left out, as an earlier table has their pairs.
    """
    known, of = np.unique(before, axis=0, return_inverse=True) if before.shape[1] else (before[:0], None)
    if 0 < len(known) <= 64:
        both = itertools.combinations(range(len(known)), 2) if alone else itertools.product(range(len(known)), repeat=2)
        apart = [(s, u) for s, u in both if not (known[s] == known[u]).any()]
        met = [(np.flatnonzero(of[:first] == s), start + np.flatnonzero(of[start:] == u), False) for s, u in apart]
    else:
        met = [(np.arange(first), np.arange(start, len(before)), alone)]
    for mine, others, twice in met:
        for low in range(0, len(mine) if len(others) else 0, block):
            yield mine[low : low + block], others[low:] if twice else others, twice


def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Matrices of the first column's equally long arrays."""
    for batch in batches:
        if batch.num_rows:
            yield np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)


def match_nearest(left: DataFrame, right: DataFrame, key: str, other: str, half: dict[str, float]) -> DataFrame:
    """key, other, square: for each row of ``left`` the row of ``right`` nearest to it in a box; rows without any are left out.

    Both sides have the columns of ``half``; cells of that size are equi-joined.
    """
    names = list(half)
    a = left.select(F.col(key), *(F.col(c).alias(f"a_{c}") for c in names), *(c.alias(f"g{i}") for i, c in enumerate(_cells(half))))
    b = right.select(F.col(other), *(F.col(c).alias(f"b_{c}") for c in names), *(c.alias(f"g{i}") for i, c in enumerate(_cells(half))))
    for i in range(len(names)):
        b = b.withColumn(f"g{i}", F.explode(F.array(F.col(f"g{i}") - 1, F.col(f"g{i}"), F.col(f"g{i}") + 1)))
    pairs = a.join(b, [f"g{i}" for i in range(len(names))])
    for c, h in half.items():
        pairs = pairs.where(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= h)
    square = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in names), F.lit(0.0))
    return pairs.groupBy(key).agg(F.min_by(other, F.struct(square, F.col(other))).alias(other), F.min(square).alias("square"))


def circular_trim(members: DataFrame, group: str, key: str, columns: list[str], radius: float) -> DataFrame:
    """Members within the radius of their group's first member."""
    first = members.groupBy(group).agg(F.min_by(F.struct(*columns), key).alias("_c"))
    square = sum(((F.col(c) - F.col(f"_c.{c}")) * (F.col(c) - F.col(f"_c.{c}")) for c in columns), F.lit(0.0))
    return members.join(first, group).where(square <= radius * radius).drop("_c")
