"""The registered queries of this package and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import ann, bpe, fingerprints, licenses, mixing, ngram_join, pii, quality, sharding, toxicity
from quern.llm._common import read_table

RANKS = "byte_bpe_50k.tiktoken"


def op1_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = licenses.scan_licenses(docs)
    base = F.filter("license_spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    strongest = F.array_max(F.transform("license_spans", lambda s: s["mandatory"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("license_spans")).alias("labels"),
        F.coalesce(strongest / (strongest + 2), F.lit(0.0)).alias("score"),
    )


def op2_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op3_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def held_out(folds: int, fold: int):
    """Whether a row's document number falls into the held-out fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def op5_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(~held_out(4, 2))
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels))
    return scored.select(
        "doc_id", held_out(4, 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


def op6_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("pii_spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    def joined(spans):
        one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
        return F.array_join(one, ",")

    return found.select(
        "doc_id",
        *(count(k) for k in pii.BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("pii_spans")).alias("spans"),
    )


def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(~held_out(5, 0))
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    return scored.select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("size")
    )
    mixed = mixing.sort_by_position(mixing.mix_curriculum(docs))
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.size("positions").cast("long").alias("occurrences"),
        F.round(F.try_element_at("positions", F.lit(1)), 9).alias("first_position"),
        F.round(F.try_element_at("positions", F.lit(-1)), 9).alias("last_position"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS ok
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source),
r AS (SELECT *, source_size * 3.0::DOUBLE / w AS ratio, sum(source_size::DOUBLE) OVER () AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum(source_size * 3.0::DOUBLE) OVER (ORDER BY ratio, source NULLS LAST
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM r),
t0 AS (SELECT source, source_size, (w - 1)::INT AS k, round(least(source_size * 3.0::DOUBLE, max(lev) OVER () * w), 6) AS target FROM l),
t AS (SELECT *, coalesce(sum(target) FILTER (WHERE k = 0) OVER (), 0) / nullif(sum(target) OVER (), 0) AS h0,
             coalesce(sum(target) FILTER (WHERE k = 1) OVER (), 0) / nullif(sum(target) OVER (), 0) AS h1,
             coalesce(sum(target) FILTER (WHERE k = 2) OVER (), 0) / nullif(sum(target) OVER (), 0) AS h2 FROM t0),
c AS (
  SELECT d.*, t.source_size, t.target, t.k, t.h0, t.h1, t.h2, row_number() OVER () AS rid, floor(t.target + 0.5)::BIGINT AS q,
         (coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ok, doc_id, size
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (
  SELECT *, q // greatest(source_size, 1) AS whole, least(greatest(q % greatest(source_size, 1) - before, 0), size) AS part FROM c),
y AS (
  SELECT *, CASE WHEN size > 0 THEN whole + (part > 0)::INT ELSE 0 END::BIGINT AS occurrences FROM x),
-- Shares of the schedule up to time u: u; 1.5 u - u^2 / 2; u / 2 + u^2 / 4 up to 1/2, then 5/16 + 3/4 (u - 1/2) + 5/4 (u - 1/2)^2.
z AS (
  SELECT *, before / q::DOUBLE AS s_first, (before + (occurrences - 1) * source_size) / q::DOUBLE AS s_last FROM y WHERE occurrences > 0),
i AS (
  SELECT z.*, CASE k WHEN 0 THEN s WHEN 1 THEN 1.5 - sqrt(2.25 - 2 * s)
                     ELSE CASE WHEN s <= 0.3125 THEN sqrt(1 + 4 * s) - 1 ELSE 0.5 + (sqrt(0.5625 + 5 * (s - 0.3125)) - 0.75) / 2.5 END END::DOUBLE AS u, last
  FROM (SELECT *, s_first AS s, false AS last FROM z UNION ALL SELECT *, s_last AS s, true AS last FROM z) z),
p AS (
  SELECT *, h0 * u + h1 * (1.5 * u - u * u / 2)
            + h2 * CASE WHEN u <= 0.5 THEN u / 2 + u * u / 4 ELSE 0.3125 + 0.75 * (u - 0.5) + 1.25 * (u - 0.5) * (u - 0.5) END AS position FROM i),
o AS (SELECT rid, max(position) FILTER (WHERE NOT last) AS first_position, max(position) FILTER (WHERE last) AS last_position FROM p GROUP BY rid)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE whole * size + part END::BIGINT AS taken, occurrences,
       round(first_position, 9)::DOUBLE AS first_position, round(last_position, 9)::DOUBLE AS last_position
FROM y LEFT JOIN o USING (rid)
"""


def op10_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    dealt = sharding.shard_rows(docs, by=["doc_id", "text_crc32", "size"], n_shards=24)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_templates": op1_license_templates,
        "op2_signature_trees": op2_signature_trees,
        "op3_edit_embedding": op3_edit_embedding,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_boosted_quality": op5_boosted_quality,
        "op6_projection_forest": op6_projection_forest,
        "op7_bootstrapped_pii": op7_bootstrapped_pii,
        "op8_compression_toxicity": op8_compression_toxicity,
        "op9_curriculum_mix": op9_curriculum_mix,
        "op10_hypergeometric_shards": op10_hypergeometric_shards,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_curriculum_mix": OP9_SQL}
