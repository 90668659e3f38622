"""Changing stored tables: replaced partitions, rows added if absent, merged labels, sorted copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write ``df`` so that it replaces the partitions that it has, and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def absent_rows(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks: what is to be appended."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def merge_labels(old: DataFrame, new: DataFrame, keys: list[str], rating: str = "rating", comment: str = "comment") -> DataFrame:
    """The labels after the changes in ``new``: it replaces or adds by key; a change without rating and comment removes.

    A rating of 0 is none.
    """
    known = F.when(F.col(rating) != 0, F.col(rating))
    changed = new.withColumn(rating, known)
    kept = changed.where(F.col(rating).isNotNull() | (F.coalesce(F.col(comment), F.lit("")) != ""))
    return old.join(changed.select(*keys).distinct(), keys, "left_anti").unionByName(kept)


def write_sorted(df: DataFrame, path: str, keys: list[str]) -> None:
    """A copy in order of the keys, so that readers skip by the files' least and largest values."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_if_absent(df: DataFrame, path: str) -> None:
    df.write.mode("ignore").parquet(path)


def scan(spark: SparkSession, path: str, columns: list[str], selector: str | None = None) -> DataFrame:
    """Some columns of the rows that an SQL condition selects; both reach the scan."""
    df = spark.read.parquet(path)
    return (df.where(selector) if selector else df).select(*columns)
