"""Array-valued measurements: masks, repair, rebinning, integration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bad_share(mask: Column, bad: int) -> Column:
    """The share of a mask array's elements with a bit of ``bad`` set."""
    return F.size(F.filter(mask, lambda m: m.bitwiseAND(F.lit(bad)) > 0)) / F.size(mask)


def replace_masked(values: Column, mask: Column, bad: int, instead: Column) -> Column:
    """The array with elements whose mask has a bad bit taken from ``instead``."""
    pairs = F.zip_with(F.zip_with(values, mask, lambda v, m: F.when(m.bitwiseAND(F.lit(bad)) == 0, v)), instead, lambda v, w: F.coalesce(v, w))
    return pairs


def within(value: Column, low: float, high: float) -> Column:
    return (value >= low) & (value < high)


def integrate(values: Column, waves: Column, low: float, high: float) -> Column:
    """Sum of values times bin width over bins that start in [low, high); bin widths are differences of ``waves``."""
    n = F.size(values)
    wide = F.transform(F.sequence(F.lit(1), n), lambda i: waves[i] - waves[i - 1])
    parts = F.zip_with(F.zip_with(values, wide, lambda v, w: v * w), F.slice(waves, F.lit(1), n), lambda vw, at: F.when((at >= low) & (at < high), vw).otherwise(0.0))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def fill_between(values: Column, first: int, last: int) -> Column:
    """Elements from ``first`` to ``last`` replaced by the line through the elements around them."""
    a, b = values[first - 1], values[last + 1]
    return F.transform(values, lambda v, i: F.when((i >= first) & (i <= last), a + (b - a) * (i - first + 1) / F.lit(float(last - first + 2))).otherwise(v))


def rebin(df: DataFrame, key: str, values: str, noise: str, mask: str, start: Column, step: float, new_start: float, new_step: float, bins: int) -> DataFrame:
    """Flux-conserving rebinning of each row's array: key, bin, flux, noise, mask.

    A new bin has the mean of the old ones weighted by overlap, the root of the
    sum of squared noise times overlap, and the OR of the masks. Each old bin
    meets the few new ones that it overlaps, which it lists itself: no join.
    Bins without any overlap are left out.
    """
    old = df.select(F.col(key), start.alias("_start"), F.posexplode(F.arrays_zip(values, noise, mask)).alias("_i", "_o"))
    low = F.col("_start") + F.col("_i") * step
    spans = old.select(key, low.alias("_low"), (low + step).alias("_high"), F.col(f"_o.{values}").alias("_v"), F.col(f"_o.{noise}").alias("_n"), F.col(f"_o.{mask}").alias("_m"))
    first = F.greatest(F.floor((F.col("_low") - new_start) / new_step), F.lit(0))
    last = F.least(F.ceil((F.col("_high") - new_start) / new_step) - 1, F.lit(bins - 1))
    met = spans.where(last >= first).select("*", F.explode(F.sequence(first, last)).alias("bin"))
    edge = F.lit(new_start) + F.col("bin") * new_step
    overlap = F.least("_high", edge + new_step) - F.greatest("_low", edge)
    some = met.select(key, F.col("bin").cast("int").alias("bin"), "_v", "_n", "_m", overlap.alias("_w")).where("_w > 1e-12")
    return some.groupBy(key, "bin").agg(
        (F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("flux"),
        F.sqrt(F.sum(F.pow(F.col("_n") * F.col("_w"), 2))).alias("noise"),
        F.bit_or("_m").alias("mask"),
    )


def smoothing_matrix(n: int, stiffness: float):
    """The matrix that smooths n equally spaced values: least squares with squared second differences weighed by ``stiffness``."""
    import numpy as np

    second = np.diff(np.eye(n), 2, axis=0)
    return np.linalg.inv(np.eye(n) + stiffness * second.T @ second)


def smooth_resample(df: DataFrame, key: str, values: str, n: int, m: int, stiffness: float = 3.0) -> DataFrame:
    """key, values: arrays of length ``n`` smoothed and read off at ``m`` equally spaced places, by batches of rows."""
    import numpy as np
    import pyarrow as pa

    at = np.linspace(0, n - 1, m)
    low = np.minimum(at.astype(int), n - 2)
    read = np.zeros((n, m))
    read[low, np.arange(m)] = 1 - (at - low)
    read[low + 1, np.arange(m)] += at - low
    whole = smoothing_matrix(n, stiffness) @ read

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), float).reshape(-1, n) @ whole
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * m, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], [key, "resampled"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(values).cast("array<double>")).mapInArrow(run, f"`{key}` {kind}, resampled array<double>")
