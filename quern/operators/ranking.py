"""Ranking, its evaluation, and selections from ranked lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.shared import stored

#: The score of what has a truth but no prediction.
UNSCORED = -1e5


def _ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` dealt by ranges of the order and stored, with ``_range``, the number of a row's range."""
    return stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, order: list[Column], name: str, sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the place (long, from 0) of each row in the whole order, without sorting in one task.

    Rows are dealt by ranges of the order and stored; each range is numbered by
    itself, after the rows of the ranges before it. The order should tell all
    rows apart. ``sums`` names columns and what their running sums, the row's
    own value included, are to be called. One row for each range is broadcast.
    """
    sums = sums or {}
    held = _ranges(df, order)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_range").orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_base"), *(F.sum(c).alias(f"_base_{n}") for c, n in sums.items()))
    bases = ["_base", *(f"_base_{n}" for n in sums.values())]
    bases = sizes.select("_range", *(F.coalesce(F.sum(b).over(before), F.lit(0)).alias(b) for b in bases))
    columns = {name: (F.col("_base") + F.row_number().over(within) - 1).cast("long")}
    columns |= {n: F.col(f"_base_{n}") + F.coalesce(F.sum(c).over(so_far), F.lit(0)) for c, n in sums.items()}
    return held.join(F.broadcast(bases), "_range").withColumns(columns).drop("_range", *bases.columns[1:])


def merge_truth(scored: DataFrame, truth: DataFrame, keys: list[str], score: str = "score", level: str = "level") -> DataFrame:
    """Truth with its predictions: score (UNSCORED where there's none) and label, whether the level is above 0."""
    return truth.join(scored, keys, "left").select(
        *keys, F.coalesce(F.col(score), F.lit(UNSCORED)).alias("score"), (F.col(level) > 0).cast("int").alias("label")
    )


def tie_aware_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Average precision in which tied rows take the precision at the end of their run.

    Null without positives. Rows are first folded by score, so the one global sort has a row for each
    distinct score.
    """
    folded = df.groupBy(score).agg(F.sum(label).alias("hits"), F.count(F.lit(1)).alias("rows"))
    above = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    precision = F.sum("hits").over(above) / F.sum("rows").over(above)
    return folded.select("hits", precision.alias("p")).agg(F.try_divide(F.sum(F.col("p") * F.col("hits")), F.sum("hits")).alias("ap"))


def precision_recall(df: DataFrame, score: str, label: str, ties: list[str]) -> DataFrame:
    """Precision and recall after each row in descending order of score."""
    ranked = numbered(df, [F.desc(score), *map(F.col, ties)], "k", {label: "hits"}).withColumn("k", F.col("k") + 1)
    ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.max("hits").alias("all"))))
    return ranked.select("k", label, (F.col("hits") / F.col("k")).alias("prec"), F.try_divide("hits", "all").alias("recall"))


def blend(df: DataFrame, first: str, second: str, ties: list[str]) -> DataFrame:
    """The mean of the ranks by two scores, and how far apart they are."""
    ranked = numbered(numbered(df, [F.desc(first), *map(F.col, ties)], "r1"), [F.desc(second), *map(F.col, ties)], "r2")
    ranked = ranked.withColumns({"r1": F.col("r1") + 1, "r2": F.col("r2") + 1})
    return ranked.select(*ties, ((F.col("r1") + F.col("r2")) / 2).alias("blend"), F.abs(F.col("r1") - F.col("r2")).alias("apart"))


def ranked(df: DataFrame, by: str, score: str, ties: list[str], *, portion: float | None = None) -> DataFrame:
    """``rank`` from 1 within each ``by``, best score first; with ``portion``, only the whole number of rows that it gives."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), *ties)))
    if portion is None:
        return out
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    return out.withColumn("_n", n).where(F.col("rank") <= F.floor(F.col("_n") * F.lit(portion))).drop("_n")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The rows of a page, from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def random_page_threshold(df: DataFrame, score: str, q: float) -> DataFrame:
    """Rows below (0.9 q) ** 5 of the way from the least to the largest score."""
    ends = df.agg(F.max(score).alias("_max"), F.min(score).alias("_min"))
    part = F.lit(math.pow(0.9 * q, 5))
    return df.crossJoin(F.broadcast(ends)).where(F.col(score) < part * (F.col("_max") - F.col("_min")) + F.col("_min")).drop("_max", "_min")


def evenly_spaced(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """``k`` rows at equal steps through the ordered list, its first and last included."""
    placed = numbered(df, order, "place")
    ordered = placed.crossJoin(F.broadcast(placed.agg(F.count(F.lit(1)).alias("_n"))))
    steps = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / F.lit(float(max(k - 1, 1)))).cast("long"))
    return ordered.where(F.array_contains(steps, F.col("place"))).drop("_n")


def first_per_class(df: DataFrame, cls: str, order: list[Column], n: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(cls).orderBy(*order))
    return df.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def keep_last(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return first_per_class(df, key, [c.desc() for c in order], 1)


def with_chunk(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """``df`` with ``chunk``, the number of a row's chunk of ``size`` consecutive rows."""
    return numbered(df, order, "_place").withColumn("chunk", F.floor(F.col("_place") / size).cast("long")).drop("_place")


def chunk_size(rows: int, chunks: int) -> int:
    return math.ceil(rows / chunks)


def nearest_rank(df: DataFrame, value: str, qs: list[float]) -> DataFrame:
    """Quantiles as values of the sorted list at place q (n - 1), rounded half to even."""
    placed = numbered(df.where(F.col(value).isNotNull()).select(F.col(value).alias("value")), [F.col("value")], "place")
    ordered = placed.crossJoin(F.broadcast(placed.agg(F.count(F.lit(1)).alias("n"))))
    wanted = F.explode(F.array(*(F.lit(float(q)) for q in qs)))
    return ordered.select("*", wanted.alias("q")).where(F.col("place") == F.bround(F.col("q") * (F.col("n") - 1)).cast("long")).select("q", "value")


def is_sorted(df: DataFrame, order: list[Column], value: str, *, descending: bool = False) -> DataFrame:
    """Whether ``value`` never falls (or rises) from one row to the next; nulls fit anywhere, and an empty table gives null.

    Each range of the order is looked at by itself; then the first value of a
    range is compared with the last one of the range before, a row for each range.
    """

    def fits(before: Column, now: Column) -> Column:
        return F.coalesce(now <= before if descending else now >= before, F.lit(True))

    within = Window.partitionBy("_range").orderBy(*order)
    held = _ranges(df, order).select("_range", F.col(value).alias("_v"), F.lag(value).over(within).alias("_before"), F.row_number().over(within).alias("_at"))
    ranges = held.groupBy("_range").agg(
        F.bool_and(fits(F.col("_before"), F.col("_v"))).alias("fits"), F.min_by("_v", "_at").alias("first"), F.max_by("_v", "_at").alias("last")
    )
    met = fits(F.lag("last").over(Window.orderBy("_range")), F.col("first"))
    return ranges.select((F.col("fits") & met).alias("fits")).agg(F.bool_and("fits").alias("is_sorted"))
