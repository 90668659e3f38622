"""Projections, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import ranking, relational
from quern.registry import query, table


@query("SELECT l_orderkey AS okey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity < 10")
def scan_project_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") < 10))
    return rows.select(F.col("l_orderkey").alias("okey"), "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("SELECT c_custkey, c_mktsegment || ' ; ' || CAST(CASE WHEN c_acctbal > 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) END AS VARCHAR) AS said FROM customer")
def concat_with_null(spark, sf_dir):
    cents = F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal") * 100).cast("long")).cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit(" ; "), cents).alias("said"))


@query("""SELECT l_returnflag, count(*)::BIGINT AS n FROM lineitem
WHERE (l_quantity > 25 AND l_discount < 0.05) OR (NOT (l_tax > 0.02) AND ((l_linestatus = 'O') <> (l_returnflag = 'R'))) GROUP BY 1""")
def boolean_logic(spark, sf_dir):
    a, b = F.col("l_quantity") > 25, F.col("l_discount") < 0.05
    c, d, e = F.col("l_tax") > 0.02, F.col("l_linestatus") == "O", F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").where((a & b) | (~c & (d != e))).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS mask FROM events WHERE (json_extract_string(props, '$.k')::BIGINT & 5) > 0")
def bitmask_filter(spark, sf_dir):
    mask = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", mask.alias("mask")).where(F.col("mask").bitwiseAND(F.lit(5)) > 0)


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' AND o_totalprice >= 100000) OR (o_orderstatus IN ('F', 'P') AND o_totalprice >= 200000)")
def class_conditional_filter(spark, sf_dir):
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").where(((s == "O") & (p >= 100000)) | (s.isin("F", "P") & (p >= 200000))).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O'")
def composite_lookup(spark, sf_dir):
    return table(spark, sf_dir, "orders").where((F.col("o_custkey") == 7) & (F.col("o_orderstatus") == "O")).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000")
def optional_filters(spark, sf_dir):
    asked = {"segment": "BUILDING", "nation": "all", "balance": 1000}
    conditions = [
        None if asked["segment"] == "all" else F.col("c_mktsegment") == asked["segment"],
        None if asked["nation"] == "all" else F.col("c_nationkey") == asked["nation"],
        None if asked["balance"] == "all" else F.col("c_acctbal") >= asked["balance"],
    ]
    return relational.filtered(table(spark, sf_dir, "customer"), *conditions).select("c_custkey")


@query("""SELECT c_custkey, round((c_acctbal - 5000) * (c_acctbal - 5000) + (c_nationkey - 12) * (c_nationkey - 12), 6) AS square FROM customer
WHERE c_acctbal BETWEEN 4500 AND 5500 AND c_nationkey BETWEEN 10 AND 14
ORDER BY (c_acctbal - 5000) * (c_acctbal - 5000) + (c_nationkey - 12) * (c_nationkey - 12), c_custkey LIMIT 1""")
def box_nearest(spark, sf_dir):
    found = relational.box_nearest(table(spark, sf_dir, "customer"), {"c_acctbal": 5000.0, "c_nationkey": 12.0}, {"c_acctbal": 500.0, "c_nationkey": 2.0}, "c_custkey")
    return found.select("c_custkey", F.round("square", 6).alias("square"))


#: A codebook with repeated keys: brands by part.
_BOOK = "book AS (SELECT p_brand AS key, (row_number() OVER (ORDER BY p_partkey) - 1)::BIGINT AS pos, p_name AS said FROM part WHERE p_size < 10)"


def _book(spark, sf_dir):
    place = (F.row_number().over(Window.orderBy("p_partkey")) - 1).cast("long")
    return table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_brand").alias("key"), place.alias("pos"), F.col("p_name").alias("said"))


@query(f"WITH {_BOOK} SELECT p_partkey, coalesce((SELECT min(pos) FROM book WHERE key = p_brand), -1)::BIGINT AS code FROM part")
def encode_first(spark, sf_dir):
    return relational.encode(table(spark, sf_dir, "part"), "p_brand", _book(spark, sf_dir), "key", "pos").select("p_partkey", "code")


@query(f"WITH {_BOOK} SELECT p_partkey, coalesce((SELECT max(pos) FROM book WHERE key = p_brand), -1)::BIGINT AS code FROM part")
def encode_last(spark, sf_dir):
    return relational.encode(table(spark, sf_dir, "part"), "p_brand", _book(spark, sf_dir), "key", "pos", keep="last").select("p_partkey", "code")


@query(f"""WITH {_BOOK}, one AS (SELECT key, arg_min(said, pos) AS said FROM book WHERE key <> 'Brand#11' GROUP BY key)
SELECT p_partkey, coalesce(said, '#') AS attached FROM part LEFT JOIN one ON key = p_brand""")
def encode_value_default(spark, sf_dir):
    book = _book(spark, sf_dir).where("key <> 'Brand#11'")
    return relational.encode_values(table(spark, sf_dir, "part"), "p_brand", book, "key", "pos", "said", "#").select("p_partkey", "attached")


@query("SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def merge_join_pairs(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").hint("merge").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", "c_custkey", "c_name")


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_join(spark, sf_dir):
    return relational.matching(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join(spark, sf_dir):
    return relational.not_matching(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def not_in_list(spark, sf_dir):
    return relational.not_in(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", table(spark, sf_dir, "labels").where("quality = 0"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT CASE WHEN quality = 0 THEN NULL ELSE doc_id END FROM labels)")
def not_in_nulls(spark, sf_dir):
    others = table(spark, sf_dir, "labels").select(F.when(F.col("quality") != 0, F.col("doc_id")).alias("other"))
    return relational.not_in(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", others, "other")


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def star_join(spark, sf_dir):
    joined = (
        table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.where("r_name = 'ASIA'").select("o_orderkey", "c_name", "n_name", "r_name")


@query("""SELECT c_custkey, o_orderkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3
LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""")
def outer_join_where(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_regionkey < 3")
    joined = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(
        table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left"
    )
    return joined.where("o_orderstatus = 'F'").select("c_custkey", "o_orderkey", "n_name")


@query("""WITH top AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)
SELECT o_orderkey, o_totalprice FROM top WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)""")
def probe_after_limit(spark, sf_dir):
    top = ranking.page(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 1, 50)
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return top.join(known, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT d.doc_id, coalesce(l.quality, -1)::INT AS code FROM documents d LEFT JOIN labels l USING (doc_id)")
def label_transfer(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("quality", F.lit(-1)).cast("int").alias("code"))


@query("""SELECT 'c' AS kind, c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey = 1
UNION ALL SELECT 's', s_suppkey, s_name FROM supplier WHERE s_nationkey = 1""")
def union_by_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_nationkey = 1").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").where("s_nationkey = 1").select(F.col("s_name").alias("name"), F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"))
    return c.unionByName(s)


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 50000")
def set_difference(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_totalprice > 50000").select("o_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(gone)


@query("""WITH e AS (SELECT o_custkey % 40 AS src, o_orderkey % 40 AS dst, o_orderkey AS pos FROM orders),
u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(pos) AS pos FROM e WHERE src <> dst GROUP BY 1, 2) SELECT * FROM u""")
def edges_dedup(spark, sf_dir):
    from quern.operators import graphs

    edges = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("src"), (F.col("o_orderkey") % 40).alias("dst"), F.col("o_orderkey").alias("pos"))
    return graphs.undirected(edges, "src", "dst", "pos")


@query("SELECT user_id, unnest(flatten(list_value(list_value(event_id, event_id + 1), list_value(event_id + 2)))) AS x FROM events")
def flatten_once(spark, sf_dir):
    nested = F.array(F.array("event_id", F.col("event_id") + 1), F.array(F.col("event_id") + 2))
    return table(spark, sf_dir, "events").select("user_id", F.explode(F.flatten(nested)).alias("x"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, c.n_nationkey AS c FROM nation a, nation b, nation c WHERE a.n_nationkey < b.n_nationkey AND b.n_nationkey < c.n_nationkey")
def combinations(spark, sf_dir):
    a, b, c = (table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(x)) for x in "abc")
    return a.join(b, F.col("a") < F.col("b")).join(c, F.col("b") < F.col("c"))


@query("SELECT a.r_regionkey AS a, b.r_regionkey AS b, c.r_regionkey AS c FROM region a, region b, region c WHERE a.r_regionkey <> b.r_regionkey AND b.r_regionkey <> c.r_regionkey AND a.r_regionkey <> c.r_regionkey")
def permutations(spark, sf_dir):
    a, b, c = (table(spark, sf_dir, "region").select(F.col("r_regionkey").alias(x)) for x in "abc")
    return a.join(b, F.col("a") != F.col("b")).join(c, (F.col("b") != F.col("c")) & (F.col("a") != F.col("c")))


@query("""WITH o AS (SELECT o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS place, o_orderkey FROM orders)
SELECT file, place, o_orderkey FROM (SELECT c_custkey AS file, (c_custkey % 5 + 1)::INT AS place FROM customer) JOIN o USING (file, place)""")
def position_join(spark, sf_dir):
    catalogue = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), (F.col("c_custkey") % 5 + 1).cast("int").alias("place"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), "o_orderkey")
    return relational.join_by_place(catalogue, rows, "file", "place", [F.col("o_orderkey")])
