"""Document fingerprints by a randomised edit embedding.

All texts share random walks: at each step of the output, the walk copies the
present character and moves on to the next one or stays, as a random bit of
(step, character) says. Texts at a small edit distance give outputs at a small
Hamming distance, since walks that an edit has pulled apart meet again soon. A
fingerprint samples the output at positions that all texts share; bands of the
sample find candidates, and comparing whole fingerprints verifies them.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._common import bound_batches, own_name, stored
from quern.operators.graphs import component_roots

#: Sampled positions of a fingerprint, a byte each.
SLOTS = 128
#: Steps after which the random bits repeat.
PERIOD = 4096
SEED = 20240502
#: Rows of one range of document numbers, about; a task streams through a range.
RANGE_ROWS = 16_384
BANDS, LIKE = 16, 0.9
#: Classes of one block of a bucket, about; blocks are compared two by two.
BLOCK = 1024


class Embedding:
    """The shared walks and sampled positions."""

    def __init__(self, slots: int = SLOTS, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        bits = rng.integers(0, 2, (256, PERIOD), dtype=np.int8)
        bits[:, -1] = 1  # so that a wait ends within a period
        # Steps until the walk leaves a character that it reaches at a step.
        waits = np.zeros((256, PERIOD), np.int64)
        ahead = np.full(256, 0)
        for step in range(2 * PERIOD - 1, -1, -1):
            ahead = np.where(bits[:, step % PERIOD] == 1, 1, ahead + 1)
            waits[:, step % PERIOD] = ahead
        self._waits = [bytes(row) for row in np.minimum(waits, 255).astype(np.uint8)]
        # A slot samples the position of least priority below the output's
        # length. With random priorities, the position after r at which the
        # least one changes is r + 1 over a uniform number, rounded down.
        records = np.full((slots, 96), np.iinfo(np.int64).max)
        records[:, 0] = 0
        for k in range(slots):
            at = 0
            for m in range(1, 96):
                at = int((at + 1) / max(rng.random(), 1e-12))
                if at >= 1 << 48:
                    break
                records[k, m] = at
        self._records = records

    @staticmethod
    def symbols(text: str) -> bytes:
        """A byte for each character: its code point below 256, else a hash of it."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        mixed = (points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
        return np.where(points < 256, points, mixed).astype(np.uint8).tobytes()

    def walk(self, symbols: bytes, before: array | None = None) -> array:
        """Steps at which the walk reaches each character and, last, the end; ``before`` is continued."""
        steps = before if before is not None else array("q", [0])
        waits, mask, step, add = self._waits, PERIOD - 1, steps[-1], steps.append
        for symbol in symbols:
            step += waits[symbol][step & mask]
            add(step)
        return steps

    def sample(self, symbols: bytes, steps: array) -> bytes:
        """The sampled characters of the output; of an empty text, zeros."""
        if not symbols:
            return bytes(len(self._records))
        below = (self._records < steps[-1]).sum(axis=1) - 1
        positions = self._records[np.arange(len(self._records)), below]
        at = np.searchsorted(np.frombuffer(steps, np.int64), positions, side="right") - 1
        return np.frombuffer(symbols, np.uint8)[at].tobytes()

    def fingerprint(self, text: str) -> bytes:
        symbols = self.symbols(text)
        return self.sample(symbols, self.walk(symbols))


def likeness(a: bytes, b: bytes) -> float:
    return float(np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8))) / len(a)


COMPARED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)
LINKS = "doc_id long, like_id long, likeness double"


def _ranges(ids: DataFrame, key: str, range_rows: int) -> list[int]:
    """The least key of each range of about ``range_rows`` rows, ascending: a number for every ``range_rows`` rows."""
    rows = ids.count()
    if not rows:
        return []
    ranged = ids.repartitionByRange(max(1, math.ceil(rows / range_rows)), key)
    return sorted(r[0] for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(key)).select(f"min({key})").collect())


def compare_with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of each text and of its edited text, their likeness, and the group of each text.

    ``near_id`` is the least number of the texts that ``near_pairs`` links to
    the text, by way of others too; its own if there are none.

    The edited text has the last quarter of the characters (rounded down)
    replaced by the first as many of the next document's, or all it has. The
    next document is the one with the next larger number; after the last comes
    the first. Repeated numbers follow one another by the text's hash; null
    numbers come last. A null text is empty; an empty text has a fingerprint of
    zeros. An empty table gives no rows; other columns are left out.

    Each text is moved once, to the task of its range of numbers, and the first
    document of a range also to the range before it. A task holds two texts at
    a time.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    last = (1 << 63) - 1
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(last)).alias("key"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    firsts = _ranges(rows.select("key"), "key", range_rows)
    if not firsts:
        return spark.createDataFrame([], T.StructType([*COMPARED.fields, T.StructField("near_id", T.LongType())]))
    n = len(firsts)
    places = np.asarray(firsts, np.int64)

    @F.pandas_udf("array<int>")
    def homes(keys):
        import pandas as pd

        at = np.searchsorted(places, keys.to_numpy(np.int64), side="right") - 1
        first = places[at] == keys.to_numpy(np.int64)
        return pd.Series([[int(i), (int(i) - 1) % n] if f else [int(i)] for i, f in zip(at, first)])

    placed = rows.select("*", F.posexplode(homes("key")).alias("guest", "home"))
    sorted_rows = placed.repartitionById(n, F.col("home")).sortWithinPartitions(
        "home", "guest", "key", F.xxhash64("text"), "text"
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedding = Embedding()
        held = None
        for batch in batches:
            out = []
            for number, value, guest in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True
            ):
                if guest and held is None:
                    continue
                symbols = embedding.symbols(value)
                steps = embedding.walk(symbols)
                mark = embedding.sample(symbols, steps)
                if held is not None:
                    out.append(_compared(embedding, *held, value, symbols, mark))
                held = None if guest else (number, value, symbols, steps, mark)
            yield pa.RecordBatch.from_pydict(
                {f.name: [r[i] for r in out] for i, f in enumerate(COMPARED.fields)},
                schema=pa.schema(
                    [("doc_id", pa.int64()), ("n_chars", pa.int64()), *((x, pa.string()) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())]
                ),
            )

    compared = stored(sorted_rows.select("doc_id", "text", "guest").mapInArrow(stream, COMPARED), "compared")
    groups = component_roots(near_pairs(compared), "doc_id", "like_id")
    joined = compared.join(groups, F.col("doc_id") == F.col("id"), "left")
    return joined.select(*compared.columns, F.coalesce("root", "doc_id").alias("near_id"))


def _compared(embedding: Embedding, number, value, symbols, steps, mark, next_value, next_symbols, next_mark) -> tuple:
    cut = len(value) // 4
    kept = len(value) - cut
    edited = value[:kept] + next_value[:cut]
    edited_symbols = symbols[:kept] + next_symbols[:cut]
    edited_mark = mark
    if edited_symbols != symbols:
        # The walk of the kept characters is the same.
        edited_mark = embedding.sample(edited_symbols, embedding.walk(next_symbols[:cut], steps[: kept + 1]))
    return (
        number,
        len(value),
        hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        mark.hex(),
        edited_mark.hex(),
        likeness(mark, edited_mark),
        likeness(mark, next_mark),
    )


def near_pairs(
    marks: DataFrame, *, doc_id: str = "doc_id", fingerprint: str = "fingerprint", bands: int = BANDS, like: float = LIKE
) -> DataFrame:
    """Links (doc_id, like_id, likeness) between documents with alike fingerprints.

    Documents with one fingerprint form a class, linked to its smallest number.
    Classes that agree in a band meet in a bucket. Buckets are cut into blocks
    by the number, and any two blocks are compared in a task of their own, so
    that every two classes of a bucket are verified. Of the pairs that are
    alike, each comparison gives a spanning forest: links connect just what all
    alike pairs would, and grow with the classes, not with their pairs.
    Null numbers or fingerprints take no part.
    """
    bound_batches(marks.sparkSession)
    rows = marks.select(F.col(doc_id).alias("id"), F.col(fingerprint).alias("mark")).where("id is not null and mark is not null")
    classes = stored(rows.groupBy("mark").agg(F.min("id").alias("id")), "marks")
    same = rows.join(classes.withColumnRenamed("id", "first"), "mark").where("id <> first")
    width = SLOTS // bands * 2
    keys = F.array(*(F.xxhash64(F.lit(b), F.substring("mark", b * width + 1, width)) for b in range(bands)))
    # Marks are moved for members of shared buckets only.
    dealt = classes.select("id", F.explode(keys).alias("bucket"))
    sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    members = stored(dealt.join(sizes, "bucket"), "members")
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    cells = members.select("id", "bucket", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    marked = cells.join(classes.select("id", F.unhex("mark").alias("mark")), "id")
    placed = marked.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", "mark")
    ordered = placed.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "id").select("bucket", "low", "high", "id", "mark")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("like_id", pa.int64()), ("likeness", pa.float64())])
        now, held = None, []
        for batch in batches:
            out = []
            for *cell, number, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != now:
                    out += _forest(held, like)
                    now, held = cell, []
                held.append((number, mark))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in _forest(held, like)], schema)

    links = same.select(F.col("id").alias("doc_id"), F.col("first").alias("like_id"), F.lit(1.0).alias("likeness"))
    return links.unionByName(ordered.mapInArrow(verify, LINKS)).distinct()


def _forest(members: list[tuple[int, bytes]], like: float) -> list[tuple[int, int, float]]:
    """(id, id, likeness) of alike members, by ascending numbers, that connect whatever alike members connect."""
    if len(members) < 2:
        return []
    marks = np.frombuffer(b"".join(m for _, m in members), np.uint8).reshape(len(members), -1)
    group, out = np.arange(len(members)), []
    for i in range(len(members) - 1):
        share = (marks[i + 1 :] == marks[i]).mean(axis=1)
        for j in np.flatnonzero(share >= like) + i + 1:
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                out.append((members[j][0], members[i][0], float(share[j - i - 1])))
    return out
