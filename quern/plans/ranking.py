"""Ranked lists, pages, deduplication and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import arrays, calendar, identifiers, sky
from quern.operators import ranking
from quern.registry import query, table


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


@query("""SELECT o_orderkey, o_orderstatus, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank,
count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE rank <= floor(n * 0.2)""")
def topn_portion(spark, sf_dir):
    return ranking.ranked(_orders(spark, sf_dir), "o_orderstatus", "o_totalprice", ["o_orderkey"], portion=0.2).select("o_orderkey", "o_orderstatus", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def paged_listing(spark, sf_dir):
    return ranking.page(_orders(spark, sf_dir), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 25).select("o_orderkey", "o_totalprice")


@query("""WITH e AS (SELECT max(o_totalprice) AS a, min(o_totalprice) AS b FROM orders) SELECT o_orderkey, o_totalprice FROM orders, e
WHERE o_totalprice < pow(0.9 * 0.8, 5) * (a - b) + b ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def rand_threshold_page(spark, sf_dir):
    below = ranking.random_page_threshold(_orders(spark, sf_dir), "o_totalprice", 0.8)
    return ranking.page(below, [F.desc("o_totalprice"), F.col("o_orderkey")], 1, 20).select("o_orderkey", "o_totalprice")


@query("""WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, place::BIGINT AS place FROM s WHERE place IN (SELECT floor(i * (n - 1) / 9.0::DOUBLE)::BIGINT FROM range(0, 10) g(i))""")
def even_sample(spark, sf_dir):
    return ranking.evenly_spaced(_orders(spark, sf_dir), [F.desc("o_totalprice"), F.col("o_orderkey")], 10).select("o_orderkey", "place")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def latest_only(spark, sf_dir):
    latest = _orders(spark, sf_dir).agg(F.max("o_orderdate").alias("o_orderdate"))
    return _orders(spark, sf_dir).join(F.broadcast(latest), "o_orderdate").select("o_orderkey")


@query("SELECT user_id, max(event_id) AS event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY user_id")
def dedup_keep_last(spark, sf_dir):
    return ranking.keep_last(table(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("SELECT user_id, event_type, epoch_us(min(ts))::BIGINT AS t FROM events GROUP BY 1, 2")
def incident_first(spark, sf_dir):
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("t"))
    return first.withColumn("t", F.unix_micros(F.col("t").cast("timestamp")))


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 3")
def first_n_per_class(spark, sf_dir):
    return ranking.first_per_class(table(spark, sf_dir, "events"), "event_type", [F.col("event_id")], 3).select("event_id", "event_type")


@query("SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) // 300)::BIGINT AS chunk FROM events")
def chunk_id(spark, sf_dir):
    return ranking.with_chunk(table(spark, sf_dir, "events").select("event_id"), [F.col("event_id")], 300)


@query("SELECT bool_and(coalesce(ok, true)) AS is_sorted FROM (SELECT ts >= lag(ts) OVER (ORDER BY event_id) AS ok FROM events)")
def sortedness(spark, sf_dir):
    return ranking.is_sorted(table(spark, sf_dir, "events"), [F.col("event_id")], "ts")


@query("SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS best, arg_min(o_orderkey, o_totalprice) AS least FROM orders GROUP BY 1")
def argmax_argmin(spark, sf_dir):
    return _orders(spark, sf_dir).groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_totalprice").alias("best"), F.min_by("o_orderkey", "o_totalprice").alias("least"))


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS cum,
round((sum(value) OVER (PARTITION BY user_id ORDER BY event_id) / sum(value) OVER (PARTITION BY user_id))::DOUBLE, 4) AS cdf FROM events""")
def cumulative_share(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("event_id")
    cum, all_of = F.sum("value").over(order), F.sum("value").over(Window.partitionBy("user_id"))
    return table(spark, sf_dir, "events").select("event_id", F.round(cum, 4).alias("cum"), F.round(cum / all_of, 4).alias("cdf"))


@query("""SELECT o_orderkey, date_diff('day', DATE '1858-11-17', o_orderdate::DATE)::INT AS mjd, strftime(o_orderdate, '%Y-%m-%d') AS day,
epoch(o_orderdate::DATE)::BIGINT AS secs, (strftime(o_orderdate, '%y%m%d%H%M'))::BIGINT AS stamp,
CAST(month(o_orderdate) AS VARCHAR) || '/' || CAST(day(o_orderdate) AS VARCHAR) || '/' || strftime(o_orderdate, '%y') AS short FROM orders""")
def calendar_functions(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    mjd = calendar.to_mjd(F.col("o_orderdate").cast("date"))
    return _orders(spark, sf_dir).select(
        "o_orderkey", mjd.alias("mjd"), F.date_format(calendar.from_mjd(mjd), "yyyy-MM-dd").alias("day"),
        calendar.date_seconds_or_missing(day).alias("secs"), calendar.stamp(F.col("o_orderdate")).alias("stamp"),
        calendar.short_date(F.col("o_orderdate")).alias("short"),
    )


@query("""WITH p AS (SELECT o_orderkey, (o_orderkey % 9000 + 1) * 1000000000 + (51000 + o_custkey % 900) * 10000 + (o_orderkey % 640 + 1) AS packed FROM orders)
SELECT o_orderkey, packed::BIGINT AS packed, (packed // 1000000000)::BIGINT AS plate, (packed // 10000 % 100000)::BIGINT AS mjd, (packed % 10000)::BIGINT AS fiber,
lpad((packed // 1000000000)::VARCHAR, 4, '0') || '-' || lpad((packed // 10000 % 100000)::VARCHAR, 5, '0') || '-' || lpad((packed % 10000)::VARCHAR, 4, '0') AS dashed FROM p""")
def id_pack_unpack(spark, sf_dir):
    key = F.col("o_orderkey")
    packed = identifiers.pack_observation(key % 9000 + 1, 51000 + F.col("o_custkey") % 900, key % 640 + 1)
    out = _orders(spark, sf_dir).select("o_orderkey", packed.alias("packed"))
    parts = identifiers.unpack_observation(F.col("packed"))
    return out.select("o_orderkey", "packed", *(c.alias(n) for n, c in parts.items()), identifiers.dashed_observation(F.col("packed")).alias("dashed"))


@query("SELECT p_partkey, r AS run, (r // 1000000)::BIGINT AS feature, (r // 1000 % 1000)::BIGINT AS scorer, (r % 1000)::BIGINT AS cls FROM (SELECT p_partkey, (p_size * 1000000 + p_partkey % 7 * 1000 + p_partkey % 3)::BIGINT AS r FROM part)")
def run_pack_unpack(spark, sf_dir):
    run = identifiers.pack_run(F.col("p_size").cast("long"), F.col("p_partkey") % 7, F.col("p_partkey") % 3)
    out = table(spark, sf_dir, "part").select("p_partkey", run.alias("run"))
    return out.select("p_partkey", "run", *(c.alias(n) for n, c in identifiers.unpack_run(F.col("run")).items()))


_NAME = "'J' || lpad((c_custkey % 24)::VARCHAR, 2, '0') || lpad((c_custkey % 60)::VARCHAR, 2, '0') || lpad((c_custkey % 59)::VARCHAR, 2, '0') || '.5' || CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END || lpad((c_custkey % 90)::VARCHAR, 2, '0') || lpad((c_custkey % 57)::VARCHAR, 2, '0') || '30.0'"


@query(f"""SELECT c_custkey, {_NAME} AS name, round(((c_custkey % 24) + (c_custkey % 60) / 60.0::DOUBLE + ((c_custkey % 59) + 0.5) / 3600.0::DOUBLE) * 15, 6)::DOUBLE AS ra,
round((CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END) * ((c_custkey % 90) + (c_custkey % 57) / 60.0::DOUBLE + 30 / 3600.0::DOUBLE), 6)::DOUBLE AS dec FROM customer""")
def sexagesimal_parse(spark, sf_dir):
    k = F.col("c_custkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    name = F.concat(F.lit("J"), two(k % 24), two(k % 60), two(k % 59), F.lit(".5"), F.when(k % 2 == 0, "+").otherwise("-"), two(k % 90), two(k % 57), F.lit("30.0"))
    named = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))
    at = identifiers.sexagesimal(F.col("name"))
    return named.select("c_custkey", "name", F.round(at["ra"], 6).alias("ra"), F.round(at["dec"], 6).alias("dec"))


_Z = "(vec_id % 50 + 1) / 100.0::DOUBLE"


@query(f"""WITH p AS (SELECT vec_id, radians((vec_id * 37 % 360)::DOUBLE) AS ra, radians((vec_id * 17 % 180 - 90)::DOUBLE) AS de, {sky.comoving_distance_sql(_Z)} AS r FROM embeddings)
SELECT vec_id, round(r, 4) AS r, round(r * cos(de) * cos(ra), 4) + 0.0::DOUBLE AS x, round(r * cos(de) * sin(ra), 4) + 0.0::DOUBLE AS y, round(r * sin(de), 4) + 0.0::DOUBLE AS z FROM p""")
def comoving_xyz(spark, sf_dir):
    v = F.col("vec_id")
    placed = table(spark, sf_dir, "embeddings").select("vec_id", sky.comoving_distance((v % 50 + 1) / F.lit(100.0)).alias("r"))
    at = sky.position((v * 37 % 360).cast("double"), (v * 17 % 180 - 90).cast("double"), F.col("r"))
    return placed.select("vec_id", F.round("r", 4).alias("r"), *((F.round(c, 4) + F.lit(0.0)).alias(n) for n, c in at.items()))


@query("""SELECT page_id, lower(split_part(url, '/', 3)) AS host, length(url)::INT AS n, regexp_extract(url, '([^/]*?)(\\.[^./]*)?$', 1) AS stem FROM pages""")
def text_functions(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.split_part("url", F.lit("/"), F.lit(3))).alias("host"), F.length("url").alias("n"), identifiers.file_stem(F.col("url")).alias("stem"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: CASE WHEN abs(x) > 0.1 THEN x - sign(x) * 0.1 ELSE 0 END)), 5) AS soft,
len(list_filter(embedding::DOUBLE[], lambda x: abs(x) > 0.1))::BIGINT AS nonzero FROM embeddings""")
def soft_threshold(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    soft = F.transform(v, lambda x: arrays.soft_threshold(x, 0.1))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(arrays.total(soft), 5).alias("soft"), F.size(F.filter(soft, lambda x: x != 0)).cast("long").alias("nonzero"))


@query("SELECT event_id, (event_id % 60 // 6)::BIGINT AS i, (event_id % 6)::BIGINT AS j, (event_id % 6 * 10 + event_id % 60 // 6)::BIGINT AS by_column FROM events")
def index_conversion(spark, sf_dir):
    flat = F.col("event_id") % 60
    i, j = F.floor(flat / 6).cast("long"), flat % 6
    return table(spark, sf_dir, "events").select("event_id", i.alias("i"), j.alias("j"), (j * 10 + i).alias("by_column"))


@query("SELECT o_custkey, list_sort(list(o_orderkey)) AS keys FROM orders GROUP BY 1")
def sorted_lists(spark, sf_dir):
    return _orders(spark, sf_dir).groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, abs(l_extendedprice / l_quantity * l_quantity - l_extendedprice) <= 1e-7 AS same, abs(l_discount - l_tax) <= 0.015 AS alike FROM lineitem")
def approximate_equality(spark, sf_dir):
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    same = arrays.nearly_equal(price / quantity * quantity, price)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", same.alias("same"), arrays.nearly_equal(F.col("l_discount"), F.col("l_tax"), 0.015).alias("alike"))


@query("SELECT c_custkey, round(3.58 - log10(1 + (c_custkey % 700) / 100.0::DOUBLE), 9) AS c0 FROM customer")
def rest_frame_shift(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(sky.rest_start(F.lit(3.58), F.col("c_custkey") % 700 / F.lit(100.0)), 9).alias("c0"))
