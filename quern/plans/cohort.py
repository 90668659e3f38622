"""Queries over exposures and conditions, made from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scores
from quern.operators import intervals, ranking
from quern.registry import query, table

def _day() -> F.Column:
    return F.expr("INTERVAL 1 DAY")


#: An exposure lasts a day; a condition may follow for another.
_X = """x AS (SELECT user_id AS person, json_extract_string(props, '$.k')::INT % 5 AS drug, ts AS s, ts + INTERVAL 1 DAY AS e
  FROM events WHERE event_type IN ('click', 'view')),
c AS (SELECT user_id AS person, json_extract_string(props, '$.k')::INT % 4 AS cond, ts AS t, event_id AS cid
  FROM events WHERE event_type = 'error')"""
_P = _X + """,
p AS (SELECT x.person, drug, s, e, cond, t, cid FROM x JOIN c ON x.person = c.person AND s <= t AND t <= e)"""


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return events.select(F.col("user_id").alias("person"), (_k() % 5).alias("drug"), F.col("ts").alias("s"), (F.col("ts") + _day()).alias("e"))


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    return events.select(F.col("user_id").alias("person"), (_k() % 4).alias("cond"), F.col("ts").alias("t"))


@query(f"WITH {_P} SELECT person, drug, cond, epoch_us(s)::BIGINT AS s, epoch_us(t)::BIGINT AS t FROM p")
def interval_join(spark, sf_dir):
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return intervals.interval_join(exposures(spark, sf_dir), conditions(spark, sf_dir)).select("person", "drug", "cond", micros("s"), micros("t"))


@query(
    f"""WITH {_X}, q AS (SELECT drug, cond, s, e, t FROM x JOIN c ON x.person = c.person AND s <= t AND t <= e + INTERVAL 2 DAY),
g AS (SELECT * FROM (VALUES (0), (1)) a(t1), (VALUES (0), (1), (2)) b(t2))
SELECT drug, cond, t1, t2, count(*) FILTER (WHERE t >= s + t1 * INTERVAL 12 HOUR AND t <= e + t2 * INTERVAL 1 DAY)::BIGINT AS n
FROM q, g GROUP BY ALL"""
)
def cooc_threshold_grid(spark, sf_dir):
    pairs = intervals.interval_join(exposures(spark, sf_dir), conditions(spark, sf_dir), F.expr("INTERVAL 2 DAYS"))
    return intervals.threshold_counts(
        pairs, {i: F.expr(f"INTERVAL {12 * i} HOURS") for i in (0, 1)}, {i: F.expr(f"INTERVAL {i} DAYS") for i in (0, 1, 2)}
    )


@query(
    f"""WITH {_P} SELECT d.drug, k.cond, count(p.person)::BIGINT AS n
FROM (SELECT DISTINCT drug FROM x) d CROSS JOIN (SELECT DISTINCT cond FROM c) k
LEFT JOIN p ON p.drug = d.drug AND p.cond = k.cond GROUP BY ALL"""
)
def cooc_counts(spark, sf_dir):
    x, c = exposures(spark, sf_dir), conditions(spark, sf_dir)
    counted = intervals.interval_join(x, c).groupBy("drug", "cond").agg(F.count(F.lit(1)).alias("n"))
    dense = x.select("drug").distinct().crossJoin(c.select("cond").distinct())
    return dense.join(counted, ["drug", "cond"], "left").select("drug", "cond", F.coalesce("n", F.lit(0)).alias("n"))


_W = _P + """,
xi AS (SELECT *, row_number() OVER () AS xid FROM x),
n AS (SELECT drug, cond, count(*) AS n FROM p GROUP BY ALL),
eu AS (SELECT drug, count(*) AS eu FROM xi WHERE NOT EXISTS
  (SELECT 1 FROM c WHERE c.person = xi.person AND s <= t AND t <= e) GROUP BY drug),
cu AS (SELECT cond, count(*) AS cu FROM c WHERE NOT EXISTS
  (SELECT 1 FROM x WHERE c.person = x.person AND s <= t AND t <= e) GROUP BY cond),
hit AS (SELECT drug, cond, count(DISTINCT cid) AS hit FROM p GROUP BY ALL),
nd AS (SELECT d.drug, (coalesce((SELECT sum(n) FROM n WHERE n.drug = d.drug), 0) + coalesce((SELECT eu FROM eu WHERE eu.drug = d.drug), 0)) AS r
  FROM (SELECT DISTINCT drug FROM x) d),
nc AS (SELECT k.cond, (SELECT count(*) FROM c WHERE c.cond = k.cond) AS occ,
  (coalesce((SELECT sum(n) FROM n WHERE n.cond = k.cond), 0) + coalesce((SELECT cu FROM cu WHERE cu.cond = k.cond), 0)) AS col
  FROM (SELECT DISTINCT cond FROM c) k),
tot AS (SELECT (SELECT sum(r) FROM nd) + coalesce((SELECT sum(cu) FROM cu), 0) AS big),
w AS (SELECT nd.drug, nc.cond, coalesce(n.n, 0)::BIGINT AS w00, (r - coalesce(n.n, 0))::BIGINT AS w01,
  (occ - coalesce(hit, 0))::BIGINT AS w10, (big - r - col + coalesce(n.n, 0))::BIGINT AS w11
  FROM nd CROSS JOIN nc CROSS JOIN tot LEFT JOIN n ON n.drug = nd.drug AND n.cond = nc.cond
  LEFT JOIN hit ON hit.drug = nd.drug AND hit.cond = nc.cond)"""
_IC = "ln((w00 + 0.5::DOUBLE) / ((w00 + w10)::DOUBLE * (w00 + w01) / (w00 + w01 + w10 + w11) + 0.5::DOUBLE))"
_PRR = "ln((w00 / (w00 + w01 + 1e-5::DOUBLE) + 1e-5::DOUBLE) / (w10 / (w10 + w11 + 1e-5::DOUBLE) + 1e-5::DOUBLE))"


@query(f"WITH {_W} SELECT * FROM w")
def contingency_2x2(spark, sf_dir):
    return intervals.contingency(exposures(spark, sf_dir), conditions(spark, sf_dir))


@query(
    f"WITH {_W.replace(_X, _X.replace('ts AS t, event_id AS cid', 'min(ts) AS t, min(event_id) AS cid').replace(chr(39) + 'error' + chr(39) + ')', chr(39) + 'error' + chr(39) + ' GROUP BY 1, 2)'))} SELECT * FROM w"
)
def contingency_incident(spark, sf_dir):
    return intervals.contingency(exposures(spark, sf_dir), conditions(spark, sf_dir), first_only=True)


def _counts() -> list[F.Column]:
    return [F.col(c) for c in ("w00", "w01", "w10", "w11")]


def score_table(spark, sf_dir) -> DataFrame:
    counts = contingency_2x2(spark, sf_dir)
    return counts.select("drug", "cond", "w00", scores.information_component(*_counts()).alias("ic"), scores.log_reporting_ratio(*_counts()).alias("prr"))


@query(f"WITH {_W} SELECT drug, cond, round({_IC}, 6) AS score FROM w")
def bcpnn(spark, sf_dir):
    return score_table(spark, sf_dir).select("drug", "cond", F.round("ic", 6).alias("score"))


@query(f"WITH {_W} SELECT drug, cond, round({_PRR}, 6) AS score FROM w")
def prr(spark, sf_dir):
    return score_table(spark, sf_dir).select("drug", "cond", F.round("prr", 6).alias("score"))


@query(f"WITH {_W} SELECT drug, cond, round({_IC}, 6) AS score FROM w WHERE w00 > 0")
def bcpnn_supported(spark, sf_dir):
    """Scores of pairs that occur; ``scores.ranked_where_unsupported`` puts the others below them."""
    return score_table(spark, sf_dir).where("w00 > 0").select("drug", "cond", F.round("ic", 6).alias("score"))


#: Truth by a rule, with levels 1 to 3; one condition isn't scored.
_TRUTH = "truth AS (SELECT drug, cond, (drug * 7 + cond * 3) % 4 AS level FROM (VALUES (0),(1),(2),(3),(4),(5)) a(drug), (VALUES (0),(1),(2),(3)) b(cond) WHERE (drug * 7 + cond * 3) % 5 <> 0)"


def truth(spark) -> DataFrame:
    drugs = spark.range(6).select(F.col("id").cast("int").alias("drug"))
    pairs = drugs.crossJoin(spark.range(4).select(F.col("id").cast("int").alias("cond")))
    rule = F.col("drug") * 7 + F.col("cond") * 3
    return pairs.where(rule % 5 != 0).withColumn("level", rule % 4)


_M = f"{_W}, {_TRUTH}, m AS (SELECT t.drug, t.cond, coalesce(round(sc, 6), -1e5) AS score, (level > 0)::INT AS label FROM truth t LEFT JOIN (SELECT drug, cond, {_IC} AS sc FROM w) USING (drug, cond))"


@query(f"WITH {_M} SELECT * FROM m")
def truth_merge(spark, sf_dir):
    return ranking.merge_truth(bcpnn(spark, sf_dir), truth(spark), ["drug", "cond"])


@query(
    f"""WITH {_M}, r AS (SELECT *, sum(label) OVER o / count(*) OVER o AS prec FROM m WINDOW o AS (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT round(sum(prec * label) / sum(label), 6)::DOUBLE AS ap FROM r"""
)
def tie_aware_ap(spark, sf_dir):
    return ranking.tie_aware_precision(truth_merge(spark, sf_dir), "score", "label").select(F.round("ap", 6).alias("ap"))


@query(
    f"""WITH {_M}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, drug, cond) AS k FROM m),
h AS (SELECT k, label, sum(label) OVER (ORDER BY k) AS hits, (SELECT sum(label) FROM m) AS tp FROM r)
SELECT k::BIGINT AS k, label, round((hits / k)::DOUBLE, 6) AS prec, round((hits / tp)::DOUBLE, 6) AS recall FROM h"""
)
def roc_points(spark, sf_dir):
    points = ranking.precision_recall(truth_merge(spark, sf_dir), "score", "label", ["drug", "cond"])
    return points.select(F.col("k").cast("long").alias("k"), "label", F.round("prec", 6).alias("prec"), F.round("recall", 6).alias("recall"))


@query(
    f"""WITH {_M}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, drug, cond) AS k FROM m),
h AS (SELECT label, sum(label) OVER (ORDER BY k) / k AS prec FROM r) SELECT round((sum(prec * label) / sum(label))::DOUBLE, 6) AS ap FROM h"""
)
def roc_ap(spark, sf_dir):
    points = ranking.precision_recall(truth_merge(spark, sf_dir), "score", "label", ["drug", "cond"])
    return points.agg(F.round(F.sum(F.col("prec") * F.col("label")) / F.sum("label"), 6).alias("ap"))


@query(
    f"""WITH {_W}, s AS (SELECT drug, cond, round({_IC}, 6) AS ic, round({_PRR}, 6) AS prr FROM w),
r AS (SELECT *, row_number() OVER (ORDER BY ic DESC, drug, cond) AS r1, row_number() OVER (ORDER BY prr DESC, drug, cond) AS r2 FROM s)
SELECT drug, cond, ((r1 + r2) / 2)::DOUBLE AS blend, abs(r1 - r2)::BIGINT AS apart FROM r"""
)
def blend_rank(spark, sf_dir):
    both = score_table(spark, sf_dir).select("drug", "cond", F.round("ic", 6).alias("ic"), F.round("prr", 6).alias("prr"))
    return ranking.blend(both, "ic", "prr", ["drug", "cond"])


@query(
    f"""WITH {_X} SELECT c.person, c.cond, epoch_us(c.t)::BIGINT AS t,
  (SELECT drug FROM x WHERE x.person = c.person AND x.s <= c.t ORDER BY s DESC LIMIT 1) AS drug_as_of FROM c"""
)
def as_of_join(spark, sf_dir):
    x = exposures(spark, sf_dir).select("person", F.col("s").alias("t"), "drug")
    joined = intervals.as_of(conditions(spark, sf_dir), x, "person", "t", "drug")
    return joined.select("person", "cond", F.unix_micros(F.col("t").cast("timestamp")).alias("t"), "drug_as_of")


@query(
    f"""WITH {_P} SELECT person, drug, s_n, n FROM (SELECT person, drug, count(DISTINCT s)::BIGINT AS s_n, count(*)::BIGINT AS n FROM p GROUP BY ALL)"""
)
def cooc_by_person(spark, sf_dir):
    return intervals.interval_join(exposures(spark, sf_dir), conditions(spark, sf_dir)).groupBy("person", "drug").agg(
        F.countDistinct("s").alias("s_n"), F.count(F.lit(1)).alias("n")
    )


@query()
def bcpnn_ranked(spark, sf_dir):
    """Scores of all pairs; one that never occurs gets -1 less a number in [0, 1) that its keys decide."""
    score = F.when(F.col("w00") > 0, F.col("ic"))
    return score_table(spark, sf_dir).select("drug", "cond", "w00", scores.ranked_where_unsupported(score, F.lit(0.0), F.col("drug"), F.col("cond")).alias("score"))


@query("""WITH r AS (SELECT o_custkey % 50 AS drug, o_orderpriority AS cond, o_orderkey,
  CASE WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 200000 THEN 2 WHEN o_totalprice < 300000 THEN 3 END::INT AS level FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY drug, cond ORDER BY o_orderkey DESC) AS back FROM r) SELECT drug, cond, level FROM n WHERE back = 1""")
def risk_levels(spark, sf_dir):
    price = F.col("o_totalprice")
    named = F.when(price < 100000, "Small risk").when(price < 200000, "Moderate risk").when(price < 300000, "Large risk").otherwise("Unknown")
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("drug"), F.col("o_orderpriority").alias("cond"), "o_orderkey", scores.risk_level(named).alias("level"))
    # The last row of a pair wins; a maximum by its place needs no sort.
    return rows.groupBy("drug", "cond").agg(F.max_by("level", "o_orderkey").alias("level"))
