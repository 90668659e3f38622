"""Mixing sources to target weights along a curriculum that changes over time.

Each source has a weight and a schedule: how its weight develops over training
time 0 to 1. The integral of a source's schedule gives its share of all words;
the integral up to t gives its cumulative demand. A source's words, in a fixed
random order and repeated as often as needed, meet that demand; inverting it
gives each occurrence of a document its time. All sources' demand up to that
time, as a share of the demand in the end, is its training position, so equal
steps of position hold equal numbers of words. The documents are then
range-sorted by position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._common import own_name, without

#: White space that separates words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a bucket of a source, at most, about; buckets are leading hexadecimal digits of the order key.
BUCKET_ROWS = 50_000
#: The schedules given to the sources in turn, as knots (time, weight) joined by straight lines. Each integrates to 1.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)),
)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _segments(schedules) -> Column:
    """An array, by schedule, of arrays of segments (t0, w0, slope, c0, c1, area); c0 and c1 are cumulative shares."""
    out = []
    for knots in schedules:
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
        total, run, parts = sum(areas), 0.0, []
        for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
            fields = {"t0": t0, "w0": w0, "slope": (w1 - w0) / (t1 - t0), "c0": run / total, "c1": (run + area) / total, "area": total}
            parts.append(F.struct(*(F.lit(float(v)).alias(k) for k, v in fields.items())))
            run += area
        out.append(F.array(*parts))
    return F.array(*out)


def invert_demand(segments: Column, share: Column) -> Column:
    """The time at which the schedule's cumulative share reaches ``share``."""

    def within(s: Column) -> Column:
        need = F.greatest(share - s["c0"], F.lit(0.0)) * s["area"]
        root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * s["slope"] * need, F.lit(0.0)))
        return s["t0"] + F.when(need <= 0, F.lit(0.0)).otherwise(2 * need / (s["w0"] + root))

    return F.least(within(F.element_at(F.filter(segments, lambda s: (share <= s["c1"]) | (s["c1"] >= 1 - 1e-12)), 1)), F.lit(1.0))


def cumulative_share(segments: Column, time: Column) -> Column:
    """The schedule's cumulative share up to ``time``."""
    at = F.element_at(F.filter(segments, lambda s: s["t0"] <= time), -1)
    step = time - at["t0"]
    return F.least(at["c0"] + step * (at["w0"] + at["slope"] * step / 2) / at["area"], F.lit(1.0))


def source_targets(sizes: DataFrame, source: str, size: str, cap: float, cycle: int, schedules: int) -> DataFrame:
    """Targets of the sources in ``sizes`` (a row each).

    Sources, by code point with null last, weigh 1 to ``cycle`` in turn and
    share all words by weight; none gets more than ``cap`` times its size, and
    what is over goes to the others by weight. With sources sorted by cap over
    weight, the level of the filling is the largest of the levels that follow
    from capping the first k of them. ``shares`` has the part of all targets that
    the sources of each schedule have. One row a source, so one task sorts them.
    """
    everything = Window.partitionBy()
    in_order = Window.orderBy(F.col(source).asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    most = F.col(size).cast("double") * F.lit(float(cap))
    return (
        sizes.withColumn("place", F.row_number().over(in_order))
        .withColumn("weight", ((F.col("place") - 1) % cycle + 1).cast("double"))
        .withColumn("ratio", most / F.col("weight"))
        .withColumn("all_words", F.sum(F.col(size).cast("double")).over(everything))
        .withColumn("capped", F.coalesce(F.sum(most).over(before), F.lit(0.0)))
        .withColumn("level", (F.col("all_words") - F.col("capped")) / F.sum("weight").over(after))
        .withColumn("target", F.round(F.least(most, F.max("level").over(everything) * F.col("weight")), 6))
        .withColumn(
            "shares",
            F.array(
                *(
                    F.coalesce(F.try_divide(F.sum(F.when((F.col("place") - 1) % schedules == k, F.col("target"))).over(everything), F.sum("target").over(everything)), F.lit(0.0))
                    for k in range(schedules)
                )
            ),
        )
        .select(source, size, "place", "target", "shares")
    )


def mix_curriculum(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    size: str = "size",
    cap: float = 3.0,
    cycle: int = 3,
    schedules=SCHEDULES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """All rows of ``docs``, with what the mix takes of each.

    Added: ``source_size`` long, ``target`` double (both of the row's source),
    ``taken`` long (words taken, repeats counted), ``positions`` array<double>
    (training position, 0 to 1, at which each occurrence starts; empty if none is taken)
    and ``last_share`` double (the part of the last occurrence that is taken,
    1 if all). Input columns of these names are replaced.

    A source's words are taken in the order of the MD5 of the document number;
    the demand ends inside one document a source, whose first words are taken.
    So a source's taken words are its target rounded to a whole number.

    ``docs`` has a whole number of words in the column ``size`` (null: 0). A
    null source is a source; rows of size 0 get 0; rows alike in number and
    size share the order arbitrarily but alike. An empty table stays empty.
    Sums run over hash buckets first, of ``bucket_rows`` rows at most, about,
    whatever the share of a source is.
    """
    added = ["source_size", "target", "taken", "positions", "last_share"]
    docs = without(docs, added)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    key, bucket, src, words = (own_name(docs, x) for x in ("order_key", "order_bucket", "mix_source", "mix_size"))
    bucket_digits = max(1, math.ceil(math.log(max(1, docs.count() / bucket_rows), 16)))
    rows = (
        docs.withColumn(key, F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
        .withColumn(bucket, F.substring(key, 1, bucket_digits))
        .withColumn(words, F.coalesce(F.col(size).cast("long"), F.lit(0)))
        .withColumn(src, F.col(source))
    )
    sums = rows.groupBy(src, bucket).agg(F.sum(words).alias("bucket_words"))
    totals = sums.groupBy(src).agg(F.sum("bucket_words").alias("source_words"))
    targets = source_targets(totals, src, "source_words", cap, cycle, len(schedules))
    before = Window.partitionBy(src).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sums.withColumn("start", F.coalesce(F.sum("bucket_words").over(before), F.lit(0)))
        .alias("b")
        .join(targets.alias("t"), F.col(f"b.{src}").eqNullSafe(F.col(f"t.{src}")))
        .select(F.struct(F.col(f"b.{src}").alias("source"), F.col("b." + bucket).alias("bucket"), "start", "source_words", "place", "target", "shares").alias("plan"))
    )
    plan = own_name(docs, "plan")
    starts = starts.withColumnRenamed("plan", plan)
    joined = rows.join(
        starts,
        F.col(src).eqNullSafe(F.col(f"{plan}.source")) & (F.col(bucket) == F.col(f"{plan}.bucket")),
    )
    in_bucket = Window.partitionBy(src, bucket).orderBy(key, F.col(doc_id), words)
    here = F.col(f"{plan}.start") + F.coalesce(F.sum(words).over(in_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at, total, demand, full, part = (own_name(docs, x) for x in ("mix_at", "mix_total", "mix_demand", "mix_full", "mix_part"))
    taken = (
        joined.withColumn(at, here)
        .withColumn(total, F.col(f"{plan}.source_words"))
        .withColumn(demand, F.floor(F.col(f"{plan}.target") + F.lit(0.5)).cast("long"))
        .withColumn(full, F.when(F.col(total) > 0, F.expr(f"`{demand}` div `{total}`")).otherwise(F.lit(0)).cast("long"))
        .withColumn(
            part,
            F.least(F.greatest(F.col(demand) - F.col(full) * F.col(total) - F.col(at), F.lit(0)), F.col(words)),
        )
    )
    every = _segments(schedules)
    shapes = F.element_at(every, ((F.col(f"{plan}.place") - 1) % len(schedules) + 1).cast("int"))

    def position(share: Column) -> Column:
        progress = lambda t: sum((cumulative_share(F.element_at(every, k + 1), t) * F.col(f"{plan}.shares")[k] for k in range(len(schedules))), F.lit(0.0))
        return F.element_at(F.transform(F.array(invert_demand(shapes, share)), progress), 1)

    occurrences = (F.col(full) + F.when(F.col(part) > 0, 1).otherwise(0)).cast("int")
    positions = F.when(
        (F.col(words) > 0) & (occurrences > 0),
        F.transform(
            F.sequence(F.lit(0), occurrences - 1),
            lambda i: position((F.col(at) + i * F.col(total)) / F.col(demand)),
        ),
    ).otherwise(F.array().cast("array<double>"))
    return taken.select(
        *kept,
        F.col(total).alias("source_size"),
        F.col(f"{plan}.target").alias("target"),
        (F.col(full) * F.col(words) + F.col(part)).alias("taken"),
        positions.alias("positions"),
        F.when(F.col(part) > 0, F.col(part) / F.col(words)).otherwise(F.lit(1.0)).alias("last_share"),
    )


def sort_by_position(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of ``mix_curriculum`` range-sorted by the position of their first occurrence, those not taken last."""
    first = F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(2.0))
    # The rest of the row parts those that aren't taken, which may be most of a large source.
    keys = [first, F.xxhash64(*(F.col(f"`{c}`") for c in mixed.columns))]
    ranged = mixed.repartitionByRange(partitions, *keys) if partitions else mixed.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def training_rows(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each occurrence, range-sorted by ``position``.

    Whole documents only: a last occurrence counts if half of it or more is
    taken. Columns added by ``mix_curriculum`` go; ``position`` is added, and an
    input column of that name is replaced.
    """
    gone = ("source_size", "target", "taken", "positions", "last_share", "position")
    kept = [F.col(f"`{c}`") for c in mixed.columns if c.lower() not in gone]
    whole = F.when(F.col("last_share") >= 0.5, F.col("positions")).otherwise(
        F.slice("positions", F.lit(1), F.greatest(F.size("positions") - 1, F.lit(0)))
    )
    rows = mixed.select(*kept, F.explode(whole).alias("position"))
    ranged = rows.repartitionByRange(partitions, "position") if partitions else rows.repartitionByRange("position")
    return ranged.sortWithinPartitions("position")
