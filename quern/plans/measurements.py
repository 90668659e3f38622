"""Quality filters and features of array-valued measurements; embeddings stand in for spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import arrays
from quern.operators import spectra
from quern.registry import query, table

#: Masks by a rule: element i of row n has the bits of (n * 31 + i * 7) % 16.
_SQL = """s AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, list_transform(range(0, 64), lambda i: ((vec_id * 31 + i * 7) % 16)::INT) AS m FROM embeddings)"""


def spectra_of(spark, sf_dir):
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.col("vec_id") * 31 + i * 7) % 16).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), mask.alias("m"))


@query(f"WITH {_SQL} SELECT vec_id FROM s WHERE len(list_filter(m, lambda x: (x & 3) > 2)) / 64.0 < 0.3 AND list_min(v) > -0.35 AND list_max(v) < 0.35 AND label NOT IN (3, 4) AND least(abs(v[1]), abs(v[2])) >= 0.01")
def quality_chain(spark, sf_dir):
    v = F.col("v")
    bad = F.size(F.filter("m", lambda x: x.bitwiseAND(F.lit(3)) > 2)) / F.lit(64.0)
    rows = spectra_of(spark, sf_dir).where((bad < 0.3) & (F.array_min(v) > -0.35) & (F.array_max(v) < 0.35) & ~F.col("label").isin(3, 4) & (F.least(F.abs(v[0]), F.abs(v[1])) >= 0.01))
    return rows.select("vec_id")


@query(f"WITH {_SQL} SELECT vec_id, round(len(list_filter(m, lambda x: (x & 4) > 0)) / 64.0::DOUBLE, 6) AS share FROM s")
def bad_pixel_share(spark, sf_dir):
    return spectra_of(spark, sf_dir).select("vec_id", F.round(spectra.bad_share(F.col("m"), 4), 6).alias("share"))


@query(f"""WITH {_SQL}, x AS (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS y, unnest(m) AS k FROM s), a AS (SELECT vec_id, avg(y) AS mu FROM x GROUP BY 1)
SELECT vec_id, round(sum(CASE WHEN (k & 8) > 0 THEN mu ELSE y END * i), 5)::DOUBLE AS said FROM x JOIN a USING (vec_id) GROUP BY 1""")
def masked_replace(spark, sf_dir):
    v = F.col("v")
    instead = F.transform(v, lambda _: arrays.mean(v))
    fixed = spectra_of(spark, sf_dir).select("vec_id", spectra.replace_masked(v, F.col("m"), 8, instead).alias("w"))
    weighted = F.aggregate(F.transform("w", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return fixed.select("vec_id", F.round(weighted, 5).alias("said"))


@query(f"WITH {_SQL} SELECT vec_id FROM s WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(v) AS y) WHERE isnan(CASE WHEN abs(y) > 0.33 THEN 'nan'::DOUBLE ELSE y END))")
def drop_nan_rows(spark, sf_dir):
    holes = F.transform("v", lambda x: F.when(F.abs(x) > 0.33, F.lit(float("nan"))).otherwise(x))
    return spectra_of(spark, sf_dir).where(~F.exists(holes, F.isnan)).select("vec_id")


@query(f"WITH {_SQL}, x AS (SELECT vec_id, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS y FROM s) SELECT vec_id, round(sum(y * (pow(10, 3.5 + 0.01 * (i + 1)) - pow(10, 3.5 + 0.01 * i))), 4) AS flux FROM x WHERE pow(10, 3.5 + 0.01 * i) >= 4000 AND pow(10, 3.5 + 0.01 * i) < 8000 GROUP BY 1")
def integrate_range(spark, sf_dir):
    from quern.functions import sky

    waves = sky.wavelengths(F.lit(3.5), F.lit(0.01), F.lit(65))
    return spectra_of(spark, sf_dir).select("vec_id", F.round(spectra.integrate(F.col("v"), waves, 4000.0, 8000.0), 4).alias("flux"))


@query(f"""WITH {_SQL}, o AS (SELECT vec_id, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS y, unnest(m) AS k FROM s),
z AS (SELECT vec_id, y, k, (vec_id % 5) * 0.1::DOUBLE + i AS lo, (vec_id % 5) * 0.1::DOUBLE + i + 1 AS hi FROM o),
g AS (SELECT b, b * 2.5::DOUBLE AS el, (b + 1) * 2.5::DOUBLE AS eh FROM range(0, 25) t(b)),
j AS (SELECT vec_id, b, y, k, least(hi, eh) - greatest(lo, el) AS w FROM z, g WHERE least(hi, eh) - greatest(lo, el) > 1e-12)
SELECT vec_id, b::INT AS bin, round(sum(y * w) / sum(w), 5) AS flux, round(sqrt(sum(pow(abs(y) * w, 2))), 5) AS noise, bit_or(k) AS mask FROM j GROUP BY 1, 2""")
def flux_rebin(spark, sf_dir):
    rows = spectra_of(spark, sf_dir).withColumn("noise", F.transform("v", F.abs))
    out = spectra.rebin(rows, "vec_id", "v", "noise", "m", (F.col("vec_id") % 5) * F.lit(0.1), 1.0, 0.0, 2.5, 25)
    return out.select("vec_id", "bin", F.round("flux", 5).alias("flux"), F.round("noise", 5).alias("noise"), "mask")


@query(f"WITH {_SQL} SELECT vec_id, round(v[20] + (v[26] - v[20]) * 3 / 6.0::DOUBLE, 5) AS middle, round(v[20], 5) AS before FROM s")
def line_removal(spark, sf_dir):
    fixed = spectra_of(spark, sf_dir).select("vec_id", spectra.fill_between(F.col("v"), 20, 24).alias("w"))
    return fixed.select("vec_id", F.round(F.col("w")[22], 5).alias("middle"), F.round(F.col("w")[19], 5).alias("before"))


@query(f"WITH {_SQL}, f AS (SELECT vec_id, list_transform(v[1:5], lambda x: abs(x) + 0.01) AS f FROM s) SELECT vec_id, round(f[1] / list_sum(f) * 5, 5) AS first, round(f[5] / list_sum(f) * 5, 5) AS last FROM f")
def colour_feature(spark, sf_dir):
    five = F.transform(F.slice("v", 1, 5), lambda x: F.abs(x) + 0.01)
    scaled = spectra_of(spark, sf_dir).select("vec_id", five.alias("f")).select("vec_id", F.transform(arrays.normalized(F.col("f"), "s1"), lambda x: x * 5).alias("f"))
    return scaled.select("vec_id", F.round(F.col("f")[0], 5).alias("first"), F.round(F.col("f")[4], 5).alias("last"))


@query()
def smooth_resample(spark, sf_dir):
    return spectra.smooth_resample(spectra_of(spark, sf_dir), "vec_id", "v", 64, 32)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice / sqrt(o_custkey + 1) >= 2000 AND o_orderdate >= TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def survey_cut(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    strong = F.col("o_totalprice") / F.sqrt(F.col("o_custkey") + 1) >= 2000
    late = F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") != "P") & strong & late).join(seen, "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT vec_id, 'https://example.org/cutout?ra=' || printf('%.6f', (vec_id * 37 % 360)::DOUBLE) || '&dec=' || printf('%.6f', (vec_id % 90)::DOUBLE) || '&scale=0.4' AS address FROM embeddings")
def cutout_addresses(spark, sf_dir):
    from quern.functions.identifiers import cutout_address

    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select("vec_id", cutout_address("https://example.org/cutout", (v * 37 % 360).cast("double"), (v % 90).cast("double")).alias("address"))
