"""Names of queries, their functions and their DuckDB SQL. Modules of ``quern.plans`` fill it in."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Modules that register queries.
PLANS = ("cohort", "relational", "aggregates", "ranking", "measurements", "spatial", "models", "storage", "streams")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its name, with the SQL that gives the same rows, if SQL can."""

    def add(function: Query) -> Query:
        key = name or function.__name__
        if key in _QUERIES:
            raise ValueError(f"{key} is registered twice")
        _QUERIES[key] = function
        if sql:
            _SQL[key] = sql
        return function

    return add


def register(name: str, function: Query, sql: str | None = None) -> None:
    query(sql, name)(function)


def _load() -> None:
    for module in PLANS:
        importlib.import_module(f"quern.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
