"""From raw documents to token ids: quality, near duplicates, personal data, source mixture, encoding."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, mixing, ngram_join, pii, quality
from quern.llm._common import read_table, stored
from quern.llm.queries import RANKS, held_out

#: Documents with a score below this go.
LEAST_QUALITY = 0.7


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with the columns ``used`` as they are and all others in one, so that no name clashes with an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(F.lit(0).alias("_none"), *others).alias("_others"))


def unpacked(df: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` again."""
    return df.select(*(F.col(c) if c in used else F.col(f"_others.`{c}`") for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labelled ones outside the held-out fold."""
    labels = read_table(spark, sf_dir, "labels").where(~held_out(4, 2))
    forest = quality.fit_quality(docs, labels)
    scored = quality.score_quality(packed(docs, "doc_id", "text"), forest, score="quality_score", keep_text=True)
    return unpacked(scored.where(F.col("quality_score") >= LEAST_QUALITY), docs, "doc_id", "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect, one of the smallest number."""
    return ngram_join.one_of_each(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    redacted = pii.redact(pii.find_pii(packed(docs, "text")))
    if "n_chars" not in docs.columns:
        return unpacked(redacted, docs, "text")
    return unpacked(redacted.withColumn("n_chars", F.length("text").cast("long")), docs, "text", "n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in order of their training positions."""
    sized = packed(docs, "doc_id", "source", "text").withColumn("mix_words", mixing.word_count(F.col("text")))
    return unpacked(mixing.training_rows(mixing.mix_curriculum(sized, size="mix_words")), docs, "doc_id", "source", "text")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the hash of the bytes that they decode to."""
    coded = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixture", mix_sources),
    ("tokens", encode_tokens),
]

#: The classifier and the encoder can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written and read again as the next one's documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
