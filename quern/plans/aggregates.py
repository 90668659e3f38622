"""Grouping, accumulation, summaries and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import arrays
from quern.operators import ranking, relational
from quern.registry import query, register, table


@query("SELECT user_id, list(event_id ORDER BY event_id) AS vals FROM events GROUP BY user_id")
def group_list(spark, sf_dir):
    return relational.grouped_values(table(spark, sf_dir, "events"), "user_id", "event_id", "event_id")


@query("""SELECT g.id::BIGINT AS user_id, coalesce(list(event_id ORDER BY event_id) FILTER (WHERE event_id IS NOT NULL), []) AS vals
FROM range(0, 200) g(id) LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') e ON e.user_id = g.id GROUP BY g.id""")
def dense_groups(spark, sf_dir):
    return relational.dense_groups(table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id", "event_id", "event_id", 200)


_BASE = "base AS (SELECT n_nationkey::BIGINT AS k, 2.0::DOUBLE AS b FROM nation WHERE n_nationkey < 20)"
for _how, _sql in (
    ("sum", "CASE WHEN g IS NULL THEN b WHEN b IS NULL THEN g ELSE b + g END"),
    ("max", "greatest(b, g)"),
    ("min", "least(b, g)"),
):

    def _accumulate(spark, sf_dir, how=_how):
        base = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("long").alias("k"), F.lit(2.0).alias("b"))
        values = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k"), "c_acctbal")
        out = relational.accumulate(values, "k", F.col("c_acctbal"), base, "b", how)
        return out.select("k", F.round("acc", 4).alias("acc"))

    register(
        f"accum_{_how}",
        _accumulate,
        f"WITH {_BASE}, f AS (SELECT c_nationkey::BIGINT AS k, {_how}(c_acctbal) AS g FROM customer GROUP BY 1) SELECT coalesce(base.k, f.k) AS k, round({_sql}, 4) AS acc FROM base FULL JOIN f ON base.k = f.k",
    )


@query(f"WITH {_BASE}, f AS (SELECT c_nationkey::BIGINT AS k, product(1 + c_acctbal / 1e6) AS g FROM customer GROUP BY 1) SELECT coalesce(base.k, f.k) AS k, round(CASE WHEN g IS NULL THEN b WHEN b IS NULL THEN g ELSE b * g END, 6) AS acc FROM base FULL JOIN f ON base.k = f.k")
def accum_prod(spark, sf_dir):
    base = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("long").alias("k"), F.lit(2.0).alias("b"))
    values = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k"), "c_acctbal")
    return relational.accumulate(values, "k", 1 + F.col("c_acctbal") / 1e6, base, "b", "prod").select("k", F.round("acc", 6).alias("acc"))


@query("SELECT p_brand, min(p_partkey) AS first_at FROM part GROUP BY p_brand")
def unique_first(spark, sf_dir):
    return relational.first_places(table(spark, sf_dir, "part"), "p_brand", "p_partkey")


@query("SELECT DISTINCT event_type FROM events")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type").distinct()


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS people, count(o_orderpriority)::BIGINT AS known, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def summary_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("people"), F.count("o_orderpriority").alias("known"),
        F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"),
    )


@query("""SELECT round(avg(date_diff('day', o_orderdate, l_shipdate)) / 30.0, 6)::DOUBLE AS months FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate""")
def mean_span_months(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.where("l_shipdate >= o_orderdate").agg(F.round(F.avg(F.datediff("l_shipdate", "o_orderdate")) / 30, 6).alias("months"))


@query("SELECT c_mktsegment, count(*)::BIGINT AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM customer GROUP BY 1")
def pct_of_total(spark, sf_dir):
    out = relational.share_of_total(table(spark, sf_dir, "customer"), "c_mktsegment")
    return out.select("c_mktsegment", "n", F.round(F.col("pct").cast("double"), 6).alias("pct"))


@query("SELECT substr(strftime(o_orderdate, '%Y'), 1, 3) AS decade, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def decade_histogram(spark, sf_dir):
    decade = F.substring(F.date_format("o_orderdate", "yyyy"), 1, 3)
    return table(spark, sf_dir, "orders").groupBy(decade.alias("decade")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT floor((2010 - (1900 + c_custkey % 100)) / 10)::BIGINT AS age, count(*) FILTER (WHERE c_nationkey % 3 = 0)::BIGINT AS a,
count(*) FILTER (WHERE c_nationkey % 3 = 1)::BIGINT AS b, count(*) FILTER (WHERE c_nationkey % 3 = 2)::BIGINT AS missing FROM customer GROUP BY 1""")
def pivot_histogram(spark, sf_dir):
    from quern.functions import calendar

    rows = table(spark, sf_dir, "customer").select(
        calendar.age_decade(1900 + F.col("c_custkey") % 100).cast("long").alias("age"),
        F.when(F.col("c_nationkey") % 3 == 0, "a").when(F.col("c_nationkey") % 3 == 1, "b").otherwise("missing").alias("sex"),
    )
    return rows.groupBy("age").pivot("sex", ["a", "b", "missing"]).count().na.fill(0)


@query("""WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem)
SELECT q::DOUBLE AS q, v AS value FROM s, (VALUES (0.0), (0.1), (0.5), (0.9), (1.0)) t(q) WHERE i = round_even(q::DOUBLE * (n - 1), 0)""")
def quantile_nearest(spark, sf_dir):
    return ranking.nearest_rank(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.0, 0.1, 0.5, 0.9, 1.0])


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query("SELECT vec_id, round(list_sort(embedding::DOUBLE[])[4], 6) AS kth FROM embeddings")
def kth_smallest(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.round(arrays.kth_smallest(F.col("v"), 3), 6).alias("kth"))


@query("""SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / 64), 6) AS rms, round(list_max(embedding::DOUBLE[]), 6) AS most,
round(list_min(embedding::DOUBLE[]), 6) AS least FROM embeddings""")
def array_summaries(spark, sf_dir):
    v = F.col("v")
    return _vectors(spark, sf_dir).select("vec_id", F.round(arrays.rms(v), 6).alias("rms"), F.round(F.array_max(v), 6).alias("most"), F.round(F.array_min(v), 6).alias("least"))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), p AS (SELECT c_nationkey, n::DOUBLE / sum(n) OVER (PARTITION BY c_nationkey) AS p FROM c)
SELECT c_nationkey, round(sum(-p * log2(p)), 6)::DOUBLE AS bits FROM p GROUP BY 1""")
def entropy(spark, sf_dir):
    counted = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).cast("double").alias("n"))
    lists = counted.groupBy("c_nationkey").agg(F.sort_array(F.collect_list("n")).alias("ns"))
    shares = F.transform("ns", lambda x: x / arrays.total(F.col("ns")))
    return lists.select("c_nationkey", F.round(arrays.entropy_bits(shares), 6).alias("bits"))


_ROW_MODES = {
    "01": ("list_min(v)", "list_max(v) - list_min(v)"),
    "pm1": ("(list_max(v) + list_min(v)) / 2", "(list_max(v) - list_min(v)) / 2"),
    "s1": ("0", "list_sum(v)"),
    "m0": ("list_avg(v)", "1"),
    "v1": ("0", "sqrt((list_dot_product(v, v) - 64 * list_avg(v) * list_avg(v)) / 63)"),
    "n1": ("0", "sqrt(list_dot_product(v, v))"),
    "m0v1": ("list_avg(v)", "sqrt((list_dot_product(v, v) - 64 * list_avg(v) * list_avg(v)) / 63)"),
}
for _mode, (_shift, _scale) in _ROW_MODES.items():

    def _normalize_row(spark, sf_dir, mode=_mode):
        positive = _vectors(spark, sf_dir).select("vec_id", F.transform("v", lambda x: F.abs(x) + 0.01).alias("v"))
        return positive.select("vec_id", F.posexplode(arrays.normalized(F.col("v"), mode)).alias("i", "x")).select(
            "vec_id", "i", F.round("x", 5).alias("x")
        )

    register(
        f"normalize_{_mode}_row",
        _normalize_row,
        f"""WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: abs(x) + 0.01::DOUBLE) AS v FROM embeddings),
k AS (SELECT vec_id, v, ({_shift})::DOUBLE AS sh, ({_scale})::DOUBLE AS sc FROM e), g AS (SELECT unnest(range(0, 64)) AS i)
SELECT vec_id, i::INT AS i, round((v[i + 1] - sh) / sc, 5) AS x FROM k, g""",
    )

_COL_MODES = {
    "01": ("min", "max - min"), "pm1": ("(max + min) / 2", "(max - min) / 2"), "s1": ("0", "total"), "m0": ("mean", "1"),
    "v1": ("0", "sd"), "n1": ("0", "norm"), "m0v1": ("mean", "sd"),
}
for _mode, (_shift, _scale) in _COL_MODES.items():

    def _normalize_col(spark, sf_dir, mode=_mode):
        from quern.operators import moments

        rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
        out = moments.normalize_columns(rows, ["p_size", "p_retailprice"], mode)
        return out.select("p_partkey", F.round("p_size", 6).alias("a"), F.round("p_retailprice", 6).alias("b"))

    def _sql(shift: str, scale: str, c: str) -> str:
        import re

        names = {"min": f"min({c}) OVER ()", "max": f"max({c}) OVER ()", "total": f"sum({c}) OVER ()", "mean": f"avg({c}) OVER ()", "sd": f"stddev_samp({c}) OVER ()", "norm": f"sqrt(sum({c}::DOUBLE * {c}) OVER ())"}
        put = lambda t: re.sub(r"[a-z]+", lambda m: names[m[0]], t)
        return f"round((({c} - ({put(shift)})) / ({put(scale)}))::DOUBLE, 6)"

    register(f"normalize_{_mode}_col", _normalize_col, f"SELECT p_partkey, {_sql(_shift, _scale, 'p_size')} AS a, {_sql(_shift, _scale, 'p_retailprice')} AS b FROM part")


@query("""WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), w AS (SELECT e.vec_id, 1.0::DOUBLE / s.n AS w FROM embeddings e JOIN s USING (label))
SELECT vec_id, round(w / avg(w) OVER (), 6) AS weight FROM w""")
def class_weights(spark, sf_dir):
    from quern.operators import models

    return models.class_weights(table(spark, sf_dir, "embeddings"), "label").select("vec_id", F.round("weight", 6).alias("weight"))


@query("""WITH s AS (SELECT n_nationkey AS k FROM (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer GROUP BY 1) WHERE n >= 60)
SELECT c_custkey, (dense_rank() OVER (ORDER BY c_nationkey) - 1)::BIGINT AS code FROM customer WHERE c_nationkey IN (SELECT k FROM s)""")
def drop_small_classes(spark, sf_dir):
    from quern.operators import models

    return models.drop_small_classes(table(spark, sf_dir, "customer"), "c_nationkey", 60).select("c_custkey", "code")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_discount), 6) AS cov, round(corr(l_quantity, l_extendedprice) * corr(l_quantity, l_extendedprice), 6) AS r2 FROM lineitem")
def correlation(spark, sf_dir):
    r = F.corr("l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").agg(F.round(r, 6).alias("r"), F.round(F.covar_pop("l_quantity", "l_discount"), 6).alias("cov"), F.round(r * r, 6).alias("r2"))
