"""Sources and sinks, by way of a scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.registry import query, table
from quern.shared import new_path
from quern.sources import tables, text


def scratch(spark) -> str:
    return new_path(spark, "scratch")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 150000")
def selector_scan(spark, sf_dir):
    return tables.scan(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"], "o_orderstatus = 'P' AND o_totalprice > 150000")


@query("SELECT c_custkey::BIGINT AS PERSON_ID, (1900 + c_custkey % 100)::BIGINT AS YEAR_OF_BIRTH, c_name AS NAME, CASE WHEN c_custkey % 3 > 0 THEN epoch(DATE '2020-01-01' + (c_custkey % 28)::INT)::DOUBLE END AS START_DATE FROM customer")
def import_delimited(spark, sf_dir):
    k, path = F.col("c_custkey"), scratch(spark)
    day = F.when(k % 3 > 0, F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 28).cast("int")), "yyyy-MM-dd"))
    people = table(spark, sf_dir, "customer").select(k.alias("PERSON_ID"), (1900 + k % 100).alias("YEAR_OF_BIRTH"), F.col("c_name").alias("NAME"), day.alias("START_DATE"))
    people.write.csv(path, sep="\t", header=True, emptyValue="")
    return text.read_delimited(spark, path)


@query("SELECT label::DOUBLE AS label, 3::INT AS n, round((embedding[1] + embedding[2] + embedding[3])::DOUBLE, 6) AS total FROM (SELECT label, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS embedding FROM embeddings)")
def sparse_text(spark, sf_dir):
    path = scratch(spark)
    v = F.col("embedding").cast("array<double>")
    parts = [F.concat(F.lit(f"{i + 1}:"), F.round(v[i], 6).cast("string")) for i in range(3)]
    table(spark, sf_dir, "embeddings").select(F.concat_ws(" ", F.col("label").cast("string"), *parts).alias("value")).write.text(path)
    rows = text.read_sparse(spark, path)
    return rows.select("label", F.size("indices").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT round(embedding[1]::DOUBLE, 5) AS a, round(embedding[2]::DOUBLE, 5) AS b FROM embeddings")
def matrix_text(spark, sf_dir):
    path = scratch(spark)
    v = F.col("embedding").cast("array<double>")
    table(spark, sf_dir, "embeddings").select(F.concat_ws(" ", F.round(v[0], 5).cast("string"), F.round(v[1], 5).cast("string")).alias("value")).write.text(path)
    return text.read_matrix(spark, path).select(F.col("values")[0].alias("a"), F.col("values")[1].alias("b"))


@query("SELECT r_regionkey::BIGINT AS run, count(*)::BIGINT AS n, sum(CASE WHEN r_regionkey = 2 THEN 1000 + n_nationkey ELSE n_nationkey END)::BIGINT AS total FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def replace_partition(spark, sf_dir):
    path = scratch(spark)
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("run"), F.col("n_nationkey").cast("long").alias("k"))
    tables.replace_partitions(rows, path, "run")
    tables.replace_partitions(rows.where("run = 2").withColumn("k", F.col("k") + 1000), path, "run")
    return spark.read.parquet(path).groupBy(F.col("run").cast("long").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey < 10 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_nationkey >= 10")
def insert_if_absent(spark, sf_dir):
    people = table(spark, sf_dir, "customer")
    old, new = people.where("c_nationkey < 10").select("c_custkey"), people.where("c_acctbal > 5000").select("c_custkey")
    return old.unionByName(tables.absent_rows(new, old, ["c_custkey"]))


@query("""WITH o AS (SELECT doc_id, 'a' AS author, quality AS rating, 'old' AS comment FROM labels),
n AS (SELECT doc_id, 'a' AS author, (doc_id % 3)::INT AS rating, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'new' END AS comment FROM documents WHERE doc_id % 5 = 0)
SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = o.doc_id) UNION ALL
SELECT doc_id, author, CASE WHEN rating <> 0 THEN rating END, comment FROM n WHERE rating <> 0 OR comment <> ''""")
def label_merge(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select("doc_id", F.lit("a").alias("author"), F.col("quality").cast("int").alias("rating"), F.lit("old").alias("comment"))
    d = F.col("doc_id")
    new = table(spark, sf_dir, "documents").where("doc_id % 5 = 0").select("doc_id", F.lit("a").alias("author"), (d % 3).cast("int").alias("rating"), F.when(d % 2 == 0, "").otherwise("new").alias("comment"))
    return tables.merge_labels(old, new, ["doc_id", "author"])


@query("SELECT count(*)::BIGINT AS n, 'orde' AS file_key FROM orders")
def file_key(spark, sf_dir):
    path = f"{scratch(spark)}/orders-copy"
    # Files are named orders-00000-..., not part-00000-...
    table(spark, sf_dir, "orders").select("o_orderkey").write.option("mapreduce.output.basename", "orders").parquet(path)
    keyed = text.with_file_key(spark.read.parquet(path), 4)
    return keyed.groupBy("file_key").agg(F.count(F.lit(1)).alias("n"))


@query()
def sampled_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").sample(0.1, seed=7).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_custkey BETWEEN 10 AND 40")
def sorted_copy(spark, sf_dir):
    path = scratch(spark)
    tables.write_sorted(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), path, ["o_custkey"])
    return tables.scan(spark, path, ["o_orderkey", "o_custkey", "o_orderpriority"], "o_custkey BETWEEN 10 AND 40")


@query("SELECT n_name, r_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def csv_sink(spark, sf_dir):
    path = scratch(spark)
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counted = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))
    tables.write_csv(counted, path)
    return spark.read.csv(path, header=True, schema=counted.schema)
