"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.shared import stored  # noqa: F401

#: Rows of one Arrow batch sent to a Python worker. Texts may be long, so a
#: batch of Spark's default 10,000 rows isn't bounded tightly enough.
BATCH_ROWS = 512
BATCH_BYTES = 32 * 1024 * 1024


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to BATCH_ROWS and BATCH_BYTES (smaller settings stay)."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        now = spark.conf.get(key, None)
        digits = "".join(c for c in str(now) if c.isdigit())
        if now is None or not digits or str(now).startswith("-") or int(digits) > most or int(digits) == 0:
            spark.conf.set(key, str(most))


def own_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name in any letter case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without input columns that clash with an operator's output ``names``."""
    clash = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in clash))


def map_columns(
    df: DataFrame,
    inputs: list[str],
    outputs: T.StructType,
    make: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]],
    drop: Iterable[str] = (),
) -> DataFrame:
    """Append columns computed batch by batch in Python.

    ``make`` runs once in each task and returns the function that turns the
    ``inputs`` of a batch into its ``outputs``. Input columns with the name of
    an output are replaced; those in ``drop`` aren't passed on.
    """
    bound_batches(df.sparkSession)
    names = [f.name for f in outputs.fields]
    gone = {n.lower() for n in [*names, *drop]}
    carried = [f for f in df.schema.fields if f.name.lower() not in gone]
    schema = T.StructType([*carried, *outputs.fields])
    needed = list(dict.fromkeys([*(f.name for f in carried), *inputs]))
    types = [_arrow_type(f.dataType) for f in outputs.fields]
    n_carried = len(carried)
    at = [needed.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            made = apply([batch.column(i) for i in at])
            made = [a if a.type == t else a.cast(t) for a, t in zip(made, types, strict=True)]
            fields = [batch.schema.field(i) for i in range(n_carried)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_carried], *made],
                schema=pa.schema([*fields, *(pa.field(n, t) for n, t in zip(names, types, strict=True))]),
            )

    return df.select(*(F.col(f"`{c}`") for c in needed)).mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {
        T.StringType: pa.string(),
        T.LongType: pa.int64(),
        T.IntegerType: pa.int32(),
        T.DoubleType: pa.float64(),
        T.FloatType: pa.float32(),
        T.BooleanType: pa.bool_(),
        T.BinaryType: pa.binary(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow_type(f.dataType)) for f in kind.fields])
    return simple[type(kind)]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
