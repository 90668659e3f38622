"""Uniform random sharding with exact shard sizes.

Method: a hypergeometric communication matrix. Rows lie in blocks (a hash of
the row decides which). The number of rows that go from each block to each
shard is drawn exactly, by multivariate hypergeometric draws without
replacement from the shards' capacities, so that every assignment of rows to
shards with the wanted shard sizes is equally likely. The draws form a tree:
the driver draws for large groups of blocks, executors for the blocks of each
group. Each block is permuted and cut at the drawn counts, the rows are
exchanged, and each shard is permuted again.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._common import own_name, without

#: Rows that one task permutes at a time, about.
BLOCK_ROWS = 20_000
#: Blocks of a group, whose draws one task makes.
GROUP_BLOCKS = 512


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """The number of good ones in ``draws`` from ``good`` + ``bad`` without replacement, for populations of any size."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good and bad else min(draws, good)
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    # Inversion outward from the mode: about as many steps as the standard deviation.
    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = rng.random() - at_mode
    down = up = mode
    p_down = p_up = at_mode
    while left > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(blocks: list[int], capacities: list[int], seed: int) -> np.ndarray:
    """Counts of rows from each block to each shard: row sums are ``blocks``, column sums ``capacities``, drawn uniformly."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = [int(c) for c in capacities]
    out = np.zeros((len(blocks), len(capacities)), dtype=np.int64)
    for i, rows in enumerate(blocks):
        draws, rest = int(rows), sum(left)
        for j, room in enumerate(left):
            take = hypergeometric(rng, room, rest - room, draws)
            rest -= room
            out[i, j] = take
            draws -= take
        left = [c - int(t) for c, t in zip(left, out[i], strict=True)]
    return out


def capacities(rows: int, shards: int) -> list[int]:
    """Shard sizes that differ by one at most."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def _cuts(sizes: DataFrame, room: list[int], seed: int) -> DataFrame:
    """Of blocks (block, rows): block, and where in its permuted rows each shard's end."""
    group = F.floor(F.col("block") / GROUP_BLOCKS).cast("int")
    grouped = sizes.withColumn("group", group)
    totals = sorted(grouped.groupBy("group").agg(F.sum("rows").alias("rows")).collect())
    matrix = communication_matrix([r["rows"] for r in totals], room, seed)
    given = sizes.sparkSession.createDataFrame([(r["group"], row) for r, row in zip(totals, matrix.tolist())], "group int, room array<bigint>")

    def draw(key, some):
        some = some.sort_values("block")
        drawn = communication_matrix(some["rows"].tolist(), list(some["room"].iloc[0]), seed + 1 + int(key[0]))
        return some[["block"]].assign(ends=np.cumsum(drawn, axis=1).tolist())

    return grouped.join(given, "group").groupBy("group").applyInPandas(draw, "block int, ends array<bigint>")


def shard_rows(
    df: DataFrame, by: list[str], n_shards: int = 24, seed: int = 20240501, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``df`` with ``shard`` (int, from 0) and ``slot`` (long, from 0 without gaps in each shard).

    Shard sizes differ by one at most. ``by`` names the columns that tell rows
    apart; they and ``seed`` decide alone, so a rerun or a recomputed partition
    gives the same result on any cluster. Rows alike in all of ``by`` are
    interchangeable, nulls count as a value, an empty table stays empty, and
    input columns called shard or slot are replaced.

    The driver draws ``n_shards`` counts for every GROUP_BLOCKS times
    ``block_rows`` rows. If ``by`` names all columns, rows alike are counted
    first and numbered, so that very many of them spread over the blocks; else
    they share a block, so ``by`` should tell rows apart.
    """
    df = without(df, ["shard", "slot"])
    if {c.lower() for c in df.columns} <= {c.lower() for c in by}:
        copy, times = own_name(df, "copy_no"), own_name(df, "copies")
        counted = df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(F.count(F.lit(1)).alias(times))
        numbered = counted.select(*(F.col(f"`{c}`") for c in df.columns), F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(copy))
        return _dealt(numbered, [*by, copy], n_shards, seed, block_rows).drop(copy)
    return _dealt(df, by, n_shards, seed, block_rows)


def _dealt(df: DataFrame, by: list[str], n_shards: int, seed: int, block_rows: int) -> DataFrame:
    spark = df.sparkSession
    n_rows = df.count()
    n_blocks = max(1, math.ceil(n_rows / block_rows))
    columns = [F.col(f"`{c}`") for c in df.columns]
    keys = [F.col(f"`{c}`") for c in by]
    block, rank, ends, part, base = (own_name(df, x) for x in ("block_no", "rank_no", "ends", "part_no", "base_no"))

    def mixed(salt: int) -> F.Column:
        return F.xxhash64(F.lit(seed + salt), *keys)

    blocked = df.withColumn(block, F.pmod(mixed(1), F.lit(n_blocks)).cast("int"))
    cuts = _cuts(blocked.groupBy(F.col(block).alias("block")).agg(F.count(F.lit(1)).alias("rows")), capacities(n_rows, n_shards), seed)
    cuts = cuts.select(F.col("block").alias(block), F.col("ends").alias(ends))
    in_block = Window.partitionBy(block).orderBy(mixed(2), *keys)
    dealt = (
        blocked.withColumn(rank, F.row_number().over(in_block).cast("long") - 1)
        .join(cuts, block)
        .withColumn("shard", F.size(F.filter(F.col(ends), lambda end: end <= F.col(rank))).cast("int"))
        .withColumn(part, F.pmod(mixed(3), F.lit(max(1, math.ceil(n_rows / n_shards / block_rows)))).cast("int"))
        .select(*columns, "shard", part)
    )
    # A shard is permuted in parts, so that no shard has to fit in one task.
    offsets = (
        dealt.groupBy("shard", part)
        .agg(F.count(F.lit(1)).alias(base))
        .withColumn(
            base,
            F.coalesce(
                F.sum(base).over(Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
    )
    in_part = Window.partitionBy("shard", part).orderBy(mixed(4), *keys)
    return (
        dealt.join(offsets, ["shard", part])
        .withColumn("slot", F.col(base) + F.row_number().over(in_part).cast("long") - 1)
        .select(*columns, "shard", "slot")
    )


def write_shards(sharded: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write the rows of each shard under ``path/shard=N``, in files that hold consecutive slots in order.

    Rows are dealt by ranges of shard and slot, so that tasks get about equal
    numbers of rows whatever the number of shards is. An empty table writes no
    shard; rows with a null shard or slot, which ``shard_rows`` never gives,
    come first.
    """
    keys = ["shard", "slot"]
    ranged = sharded.repartitionByRange(partitions, *keys) if partitions else sharded.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("shard").parquet(path)
