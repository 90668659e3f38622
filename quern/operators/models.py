"""Classes, simple classifiers and their evaluation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ranking import numbered


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``weight`` 1 / size of the class, scaled to mean 1."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = sizes.agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_classes"))
    joined = df.join(sizes, label).crossJoin(F.broadcast(totals))
    return joined.withColumn("weight", F.col("_rows") / (F.col("_n") * F.col("_classes"))).drop("_n", "_rows", "_classes")


def drop_small_classes(df: DataFrame, label: str, least: int) -> DataFrame:
    """Rows of classes with at least so many rows; ``code`` numbers those classes from 0."""
    kept = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    coded = kept.select(label, (F.row_number().over(Window.orderBy(label)).cast("long") - 1).alias("code"))
    return df.join(coded, label)


def fit_naive_bayes(df: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """One row for each label with two rows at least: its share, and arrays of means and sample deviations."""
    x = [F.col(vector)[i] for i in range(dims)]
    fitted = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.array(*(F.avg(c) for c in x)).alias("mu"), F.array(*(F.stddev_samp(c) for c in x)).alias("sd")
    )
    return fitted.where("n >= 2").withColumn("prior", F.col("n") / F.sum("n").over(Window.partitionBy()))


def log_likelihoods(df: DataFrame, key: str, vector: str, model: DataFrame, label: str, dims: int) -> DataFrame:
    """key, label, ll for each row and label; the model has a row for each label and is broadcast."""
    parts = F.aggregate(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        F.lit(0.0),
        lambda s, i: s - F.log(F.col("sd")[i]) - F.pow((F.col(vector)[i] - F.col("mu")[i]) / F.col("sd")[i], 2) / 2,
    )
    constant = dims * math.log(2 * math.pi) / 2
    own = model.select(F.col(label).alias("_label"), "mu", "sd", "prior")
    return df.select(key, vector).crossJoin(F.broadcast(own)).select(key, F.col("_label").alias(label), (F.log("prior") + parts - constant).alias("ll"))


def predict_naive_bayes(df: DataFrame, key: str, vector: str, model: DataFrame, label: str, dims: int) -> DataFrame:
    likely = log_likelihoods(df, key, vector, model, label, dims)
    return likely.groupBy(key).agg(F.max_by(label, F.struct(F.col("ll"), -F.col(label))).alias("pred"), F.max("ll").alias("ll"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Counts of each true and predicted label of the labels that occur, zeros included."""
    labels = df.select(F.col(label).alias("l")).union(df.select(F.col(predicted))).distinct()
    cells = labels.select(F.col("l").alias("truth")).crossJoin(labels.select(F.col("l").alias("pred")))
    counted = df.groupBy(F.col(label).alias("truth"), F.col(predicted).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(counted, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def report(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F of scores above the threshold; null where there is nothing to divide by."""
    said, true = F.col(score) > threshold, F.col(label) == 1
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = df.agg(count(said & true).alias("tp"), count(said & ~true).alias("fp"), count(~said & true).alias("fn"), count(said == true).alias("ok"), F.count(F.lit(1)).alias("n"))
    p, r = (F.try_divide("tp", F.col("tp") + F.col(other)) for other in ("fp", "fn"))
    return sums.select(F.try_divide("ok", "n").alias("accuracy"), p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f"))


def regression_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Exact hits in percent, mean squared error and squared correlation."""
    r = F.corr(truth, predicted)
    return df.agg(
        F.avg(F.when(F.col(truth) == F.col(predicted), 100.0).otherwise(0.0)).alias("acc"),
        F.avg((F.col(truth) - F.col(predicted)) * (F.col(truth) - F.col(predicted))).alias("mse"),
        (r * r).alias("scc"),
    )


def folds(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """``fold`` 0 to k - 1: consecutive parts of equal size of a random order that the key and seed decide."""
    placed = numbered(df, [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)], "_place")
    placed = placed.crossJoin(F.broadcast(placed.agg(F.count(F.lit(1)).alias("_rows"))))
    return placed.withColumn("fold", F.floor(F.col("_place") / F.ceil(F.col("_rows") / k)).cast("int")).drop("_place", "_rows")


def query_by_margin(probabilities: DataFrame, key: str, label: str, p: str, n: int) -> DataFrame:
    """The ``n`` keys whose two likeliest labels are nearest."""
    ranked = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(p), label))
    top = probabilities.withColumn("_r", ranked).where("_r <= 2").groupBy(key).agg((F.max(p) - F.min(p)).alias("margin"))
    return top.orderBy("margin", key).limit(n)


def query_by_entropy(probabilities: DataFrame, key: str, p: str, n: int) -> DataFrame:
    """The ``n`` keys whose labels are most uncertain, by entropy in bits."""
    bits = F.sum(F.when(F.col(p) > 0, -F.col(p) * F.log2(F.col(p))).otherwise(0.0))
    return probabilities.groupBy(key).agg(bits.alias("bits")).orderBy(F.desc("bits"), key).limit(n)


def query_least_confident(probabilities: DataFrame, key: str, p: str, n: int) -> DataFrame:
    """The ``n`` keys whose likeliest label is least likely."""
    return probabilities.groupBy(key).agg(F.max(p).alias("top")).orderBy("top", key).limit(n)


def truncate_classes(df: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """At most so many rows of each class: the first by the MD5 of the key."""
    order = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def draw_multinomial(spark, shares: dict, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows (draw, value), each value with its share; the draws depend on the seed and their number alone."""
    total, ends, so_far = float(sum(shares.values())), [], 0.0
    for value, share in shares.items():
        so_far += share / total
        ends.append((value, so_far))
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 40)) / float(1 << 40)
    chosen = F.lit(ends[-1][0])
    for value, end in reversed(ends[:-1]):
        chosen = F.when(F.col("u") < end, F.lit(value)).otherwise(chosen)
    return spark.range(n).withColumn("u", unit).select(F.col("id").alias("draw"), chosen.alias("value"))
