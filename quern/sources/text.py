"""Text sources: delimited tables with types by column name, numeric matrices, tagged matrices, sparse rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.calendar import date_seconds


def schema_from_header(names: list[str]) -> T.StructType:
    """Types by name: identifiers, years and flags are whole numbers, dates are epoch seconds, all else is text."""
    fields = []
    for name in names:
        upper = name.upper()
        if upper.endswith("_ID") or upper.startswith("YEAR_") or upper in ("ASSOCIATION_PRESENT", "A_TYPE"):
            kind = T.LongType()
        elif upper.endswith("_DATE"):
            kind = T.DoubleType()
        else:
            kind = T.StringType()
        fields.append(T.StructField(name, kind))
    return T.StructType(fields)


def read_delimited(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """A delimited table with a header. Fields aren't quoted; empty ones are null; malformed numbers and dates are null."""
    names = spark.read.text(path).first()
    header = names[0].split(separator) if names else []
    raw = spark.read.csv(path, sep=separator, header=True, quote="", schema=T.StructType([T.StructField(n, T.StringType()) for n in header]))
    columns = []
    for field in schema_from_header(header).fields:
        text = F.nullif(F.col(f"`{field.name}`"), F.lit(""))
        if isinstance(field.dataType, T.DoubleType):
            text = date_seconds(text).cast("double")
        elif isinstance(field.dataType, T.LongType):
            text = text.try_cast("long")
        columns.append(text.alias(field.name))
    return raw.select(*columns)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """line, values (array<double>) of numeric text; blank lines are left out, and lines without a number (headers) too."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"[\s,]+").alias("parts"))
    values = F.transform("parts", lambda p: p.try_cast("double"))
    return rows.select("line", values.alias("values")).where(F.exists("values", lambda v: v.isNotNull()))


_TAG = r"^\s*(N_POINTS|DIMENSION|DATA)\b\s*[:=]?\s*(\d*)"


def read_tagged_matrix(spark: SparkSession, path: str, missing: float = -888.0) -> DataFrame:
    """line, values of a text with tags N_POINTS, DIMENSION and DATA and comments from #; what isn't a number is ``missing``.

    Raises ValueError if the number of rows isn't as tagged.
    """
    text = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.trim(F.regexp_replace("value", "#.*$", "")).alias("t")).where("t <> ''")
    tags = {r["tag"]: r["n"] for r in text.select(F.regexp_extract("t", _TAG, 1).alias("tag"), F.regexp_extract("t", _TAG, 2).alias("n")).where("tag <> ''").collect()}
    values = F.transform(F.split("t", r"[\s,]+"), lambda p: F.coalesce(p.try_cast("double"), F.lit(missing)))
    rows = text.where(~F.col("t").rlike(_TAG)).select("line", values.alias("values"))
    if tags.get("N_POINTS") and rows.count() != int(tags["N_POINTS"]):
        raise ValueError(f"{path}: the number of rows isn't {tags['N_POINTS']}")
    return rows


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """label, indices, values of lines ``label index:value ...``; lines without features are kept."""
    text = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") > 0)
    pairs = F.filter(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), lambda x: x.contains(":"))
    return text.select(
        F.col("p")[0].cast("double").alias("label"),
        F.transform(pairs, lambda x: F.split_part(x, F.lit(":"), F.lit(1)).cast("int")).alias("indices"),
        F.transform(pairs, lambda x: F.split_part(x, F.lit(":"), F.lit(2)).cast("double")).alias("values"),
    )


def with_file_key(df: DataFrame, length: int) -> DataFrame:
    """``df`` with ``file_key``, the first characters of the name of the file that a row came from."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return df.select("*", F.substring(name, 1, length).alias("file_key"))


def safe_name(name: str) -> str:
    return re.sub(r"\W+", "_", name)
