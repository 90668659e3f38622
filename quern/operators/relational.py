"""Dictionary encoding, lookup joins, grouping and accumulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def encode(df: DataFrame, value: str, codebook: DataFrame, key: str, position: str, *, keep: str = "first", out: str = "code") -> DataFrame:
    """``df`` with the codebook's position of each value; -1 if it has none.

    Of a key that the codebook has twice, the first or the last position counts.
    """
    pick = {"first": F.min, "last": F.max}[keep]
    book = codebook.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(pick(position).cast("long").alias("_code"))
    joined = df.join(book, F.col(value) == F.col("_key"), "left")
    return joined.withColumn(out, F.coalesce("_code", F.lit(-1))).drop("_key", "_code")


def encode_values(df: DataFrame, value: str, codebook: DataFrame, key: str, position: str, attached: str, default, *, keep: str = "first", out: str = "attached") -> DataFrame:
    """``df`` with the value that the codebook attaches to each key, or ``default``."""
    pick = {"first": F.min_by, "last": F.max_by}[keep]
    book = codebook.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(pick(attached, position).alias("_val"))
    joined = df.join(book, F.col(value) == F.col("_key"), "left")
    return joined.withColumn(out, F.coalesce("_val", F.lit(default))).drop("_key", "_val")


def matching(df: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    return df.join(others.select(*on).distinct(), on, "left_semi")


def not_matching(df: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    return df.join(others.select(*on).distinct(), on, "left_anti")


def not_in(df: DataFrame, column: str, others: DataFrame, other: str) -> DataFrame:
    """SQL's NOT IN: no row at all if a null is among the others, and no row with a null of its own unless there are none."""
    seen = others.agg(F.count(F.lit(1)).alias("_n"), F.count(other).alias("_known"))
    rest = df.join(others.select(F.col(other).alias("_other")).distinct(), F.col(column) == F.col("_other"), "left_anti")
    return rest.crossJoin(F.broadcast(seen)).where((F.col("_n") == 0) | (F.col("_n") == F.col("_known")) & F.col(column).isNotNull()).drop("_n", "_known")


def grouped_values(df: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """The values of each key in the order of their positions."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(F.transform(pairs, lambda x: x["v"]).alias("vals"))


def dense_groups(df: DataFrame, key: str, position: str, value: str, n: int) -> DataFrame:
    """Groups 0 to n - 1 with their values; empty ones have an empty list."""
    every = df.sparkSession.range(n).select(F.col("id").alias(key))
    kind = df.schema[value].dataType.simpleString()
    joined = every.join(grouped_values(df, key, position, value), key, "left")
    return joined.select(key, F.coalesce("vals", F.array().cast(f"array<{kind}>")).alias("vals"))


_COMBINE = {
    "sum": (F.sum, lambda a, b: a + b),
    "prod": (F.product, lambda a, b: a * b),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def accumulate(df: DataFrame, key: str, value: Column, base: DataFrame, start: str, how: str) -> DataFrame:
    """``base`` with the values of its keys accumulated onto ``start``; keys that it lacks start from nothing."""
    gather, combine = _COMBINE[how]
    found = df.groupBy(key).agg(gather(value).cast("double").alias("_got"))
    joined = base.select(key, F.col(start).cast("double").alias("_start")).join(found, key, "full")
    both = F.when(F.col("_got").isNull(), F.col("_start")).when(F.col("_start").isNull(), F.col("_got")).otherwise(combine(F.col("_start"), F.col("_got")))
    return joined.select(key, both.alias("acc"))


def first_places(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values and where each stands first."""
    return df.groupBy(value).agg(F.min(position).alias("first_at"))


def share_of_total(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by key and their percentage of all rows."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def box_nearest(df: DataFrame, centre: dict[str, float], half: dict[str, float], id_col: str) -> DataFrame:
    """The row in a box around the centre that is nearest to it."""
    inside = [F.col(c).between(v - half[c], v + half[c]) for c, v in centre.items()]
    square = sum(((F.col(c) - v) * (F.col(c) - v) for c, v in centre.items()), F.lit(0.0))
    found = df
    for condition in inside:
        found = found.where(condition)
    return found.agg(F.min_by(id_col, F.struct(square, F.col(id_col))).alias(id_col), F.min(square).alias("square"))


def filtered(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows that meet all conditions; a condition of None is no condition."""
    for condition in conditions:
        if condition is not None:
            df = df.where(condition)
    return df


def join_by_place(catalogue: DataFrame, rows: DataFrame, file: str, index: str, order: list[Column]) -> DataFrame:
    """``catalogue`` with the row of its file at its ``index`` (from 1); rows of ``rows`` are counted within each file in ``order``.

    An index that the file doesn't have, or a null file or index, gives no row.
    """
    placed = rows.withColumn(index, F.row_number().over(Window.partitionBy(file).orderBy(*order)))
    return catalogue.join(placed, [file, index])
