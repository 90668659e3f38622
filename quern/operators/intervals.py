"""Interval joins of exposures and conditions, and exact contingency counts.

Exposures are rows (person, drug, s, e), conditions rows (person, cond, t). A
pair occurs together if it is one person's and s <= t <= e + slack. The join is
an equi-join on the person with a range condition, so it shuffles by person
alone. Repeated rows are folded into one with a weight before any join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _folded(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(weight))


def _together(slack: Column | None, person: str = "person") -> Column:
    end = F.col("x.e") if slack is None else F.col("x.e") + slack
    return (F.col(f"x.{person}") == F.col(f"c.{person}")) & (F.col("x.s") <= F.col("c.t")) & (F.col("c.t") <= end)


def interval_join(exposures: DataFrame, conditions: DataFrame, slack: Column | None = None) -> DataFrame:
    """All pairs that occur together: person, drug, s, e, cond, t."""
    return (
        exposures.alias("x")
        .join(conditions.alias("c"), _together(slack))
        .select("x.person", "x.drug", "x.s", "x.e", "c.cond", "c.t")
    )


def incident(conditions: DataFrame) -> DataFrame:
    """The first occurrence of each condition of each person."""
    return conditions.groupBy("person", "cond").agg(F.min("t").alias("t"))


def threshold_counts(pairs: DataFrame, after_start: dict[int, Column], after_end: dict[int, Column]) -> DataFrame:
    """Of joined pairs: how many have t >= s + t1 and t <= e + t2, for all thresholds in one pass; drug, cond, t1, t2, n."""
    columns, labels = [], []
    for a, first in after_start.items():
        for b, last in after_end.items():
            hit = (F.col("t") >= F.col("s") + first) & (F.col("t") <= F.col("e") + last)
            columns.append(F.sum(F.when(hit, 1).otherwise(0)).cast("long").alias(f"n_{a}_{b}"))
            labels.append((a, b))
    wide = pairs.groupBy("drug", "cond").agg(*columns)
    rows = F.array(
        *(F.struct(F.lit(a).alias("t1"), F.lit(b).alias("t2"), F.col(f"n_{a}_{b}").alias("n")) for a, b in labels)
    )
    return wide.select("drug", "cond", F.inline(rows))


def contingency(
    exposures: DataFrame, conditions: DataFrame, slack: Column | None = None, *, first_only: bool = False, same_window: bool = False
) -> DataFrame:
    """w00, w01, w10, w11 of every drug and condition, unobserved pairs included.

    The unit is an exposure, a condition occurrence, or a pair of them that
    occur together; units with neither partner count once. ``w10`` counts
    occurrences of the condition without an exposure to the drug: within
    [s, e], or with ``same_window`` within [s, e + slack].
    """
    if first_only:
        conditions = incident(conditions)
    x = _folded(exposures.select("person", "drug", "s", "e"), ["person", "drug", "s", "e"], "k")
    c = _folded(conditions.select("person", "cond", "t"), ["person", "cond", "t"], "m")
    together = x.alias("x").join(c.alias("c"), _together(slack))
    n_dc = together.groupBy("x.drug", "c.cond").agg(F.sum(F.col("x.k") * F.col("c.m")).alias("n"))
    near = x.alias("x").join(c.alias("c"), _together(slack if same_window else None))
    hits = near.groupBy("x.drug", "c.person", "c.cond", "c.t").agg(F.max("c.m").alias("m"))
    hit_dc = hits.groupBy("drug", "cond").agg(F.sum("m").alias("hit"))
    alone_x = x.alias("x").join(c.alias("c"), _together(slack), "left_anti")
    alone_c = c.alias("c").join(x.alias("x"), _together(slack), "left_anti")
    eu = alone_x.groupBy("drug").agg(F.sum("k").alias("eu"))
    cu = alone_c.groupBy("cond").agg(F.sum("m").alias("cu"))
    n_d = n_dc.groupBy("drug").agg(F.sum("n").alias("n_d"))
    n_c = n_dc.groupBy("cond").agg(F.sum("n").alias("n_c"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    drugs = (
        x.select("drug").distinct().join(n_d, "drug", "left").join(eu, "drug", "left")
        .select("drug", (zero("n_d") + zero("eu")).alias("row"))
    )
    conds = (
        c.groupBy("cond").agg(F.sum("m").alias("occ")).join(n_c, "cond", "left").join(cu, "cond", "left")
        .select("cond", "occ", (zero("n_c") + zero("cu")).alias("col"), zero("cu").alias("cu"))
    )
    # The result itself has a row for each drug and condition.
    total = drugs.agg(F.sum("row").alias("rows")).crossJoin(conds.agg(F.sum("cu").alias("cus")))
    dense = drugs.crossJoin(conds).crossJoin(total)
    return (
        dense.join(n_dc, ["drug", "cond"], "left").join(hit_dc, ["drug", "cond"], "left")
        .select(
            "drug",
            "cond",
            zero("n").alias("w00"),
            (F.col("row") - zero("n")).alias("w01"),
            (F.col("occ") - zero("hit")).alias("w10"),
            (F.col("rows") + F.col("cus") - F.col("row") - F.col("col") + zero("n")).alias("w11"),
        )
    )


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` at or before its time: one sort by key and time, no range join."""
    tag = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(1))
    other = right.select(F.col(by), F.col(at), F.col(value).alias("_v")).withColumn("_left", F.lit(0))
    ordered = Window.partitionBy(by).orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = tag.unionByName(other, allowMissingColumns=True)
    return both.withColumn(f"{value}_as_of", F.last("_v", ignorenulls=True).over(ordered)).where("_left = 1").drop("_left", "_v")
