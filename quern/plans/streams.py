"""Streaming queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.storage import scratch
from quern.registry import query, table
from quern.streaming import events as streams

#: Files that the events are dealt into by time; each is a micro-batch.
FILES = 3


def _stream(spark, sf_dir):
    """The events as a stream of files in order of time, written one after another."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "events")
    seconds = rows.select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    cuts = [None, *seconds.approxQuantile("t", [i / FILES for i in range(1, FILES)], 0.01), None]
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    for low, high in zip(cuts, cuts[1:]):
        part = (F.lit(True) if low is None else at >= low) & (F.lit(True) if high is None else at < high)
        rows.where(part).repartition(1).write.mode("append").parquet(path)
    return streams.read_events(spark, path, rows.schema)


@query("SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    out = streams.run_to_end(streams.windowed_counts(_stream(spark, sf_dir), "1 day"), "complete")
    return out.select(F.col("start").cast("long").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH w AS (SELECT epoch(date_trunc('day', ts))::BIGINT - 86400 * k AS start, event_type FROM events, (VALUES (0), (1)) t(k))
SELECT start, event_type, count(*)::BIGINT AS n FROM w GROUP BY 1, 2""")
def stream_sliding(spark, sf_dir):
    out = streams.run_to_end(streams.windowed_counts(_stream(spark, sf_dir), "2 days", "1 day"), "complete")
    return out.select(F.col("start").cast("long").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts))::BIGINT AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    out = streams.run_to_end(streams.sessions(_stream(spark, sf_dir), "6 hours"), "complete")
    return out.select("user_id", F.unix_micros("start").alias("start"), "n")


@query("SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, sf_dir):
    return streams.run_to_end(streams.first_seen(_stream(spark, sf_dir), ["event_id"])).select("event_id")


@query()
def stream_factors(spark, sf_dir):
    path = scratch(spark)
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    rows.repartition(2).write.parquet(path)
    model = streams.learn_factors(spark.readStream.schema(rows.schema).parquet(path), "v", 4, 64, f"{scratch(spark)}-state")
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(model.d)], "i int, direction array<double>")
