"""Streams of events (event_id, ts, user_id, event_type, value) and their windowed summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.factors import OnlineFactors
from quern.shared import new_path


def read_events(spark: SparkSession, folder: str, schema, files_at_once: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of a user's events with no pause longer than ``gap``."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once, as long as its repeats come within the time allowed."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream gives for the files there are, written as Parquet, a folder for each micro-batch.

    A batch that is run again replaces what it wrote before. In the modes that
    give the whole result each time, the last batch's is returned.
    """
    spark = stream.sparkSession
    path, checkpoint = new_path(spark, "stream"), new_path(spark, "stream-state")
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        done.append(number)

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    wanted = sorted(set(done))[-1:] if mode == "complete" else sorted(set(done))
    return spark.read.schema(stream.schema).parquet(*(f"{path}/batch-{n}" for n in wanted)) if wanted else spark.createDataFrame([], stream.schema)


def learn_factors(stream: DataFrame, vector: str, rank: int, dims: int, checkpoint: str | None = None) -> OnlineFactors:
    """Factors learned micro-batch by micro-batch.

    Executors add up the batch's statistics under the factors so far; the
    driver gets ``rank`` times ``rank + dims`` sums of each batch.
    """
    model = OnlineFactors(rank, dims)

    def learn(batch: DataFrame, _: int) -> None:
        now = model

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b = np.zeros((rank, rank)), np.zeros((rank, dims))
            for some in batches:
                x = np.asarray(some.column(0).flatten(), float).reshape(-1, dims)
                c = now.coefficients(x)
                a, b = a + c.T @ c, b + c.T @ x
            flat = np.concatenate([a.ravel(), b.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(flat.size)), pa.array(flat)], ["cell", "value"])

        rows = batch.select(F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == dims)
        got = dict(rows.mapInArrow(sums, "cell long, value double").groupBy("cell").agg(F.sum("value")).collect())
        if got:
            flat = np.array([got[i] for i in range(rank * (rank + dims))])
            model.add(flat[: rank * rank].reshape(rank, rank), flat[rank * rank :].reshape(rank, dims))

    writer = stream.writeStream.foreachBatch(learn).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
    return model
