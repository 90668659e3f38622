"""Moments, classifiers, clusterings and anomaly scores over embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quern.operators import factors, mixtures, models, moments
from quern.registry import query, table

#: Components of a vector.
DIMS = 64


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


_X = "x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding::DOUBLE[]) AS y FROM embeddings)"


@query(f"WITH {_X} SELECT a.i::INT AS i, b.i::INT AS j, round(covar_pop(a.y, b.y), 7) AS cov FROM x a JOIN x b USING (vec_id) GROUP BY 1, 2")
def mean_cov(spark, sf_dir):
    _, _, cov = moments.moments(_vectors(spark, sf_dir), "v", DIMS)
    return _cells(spark, cov)


@query(f"""WITH {_X}, w AS (SELECT a.i, b.i AS j, a.y AS p, b.y AS q, (a.label + 1)::DOUBLE AS w FROM x a JOIN x b USING (vec_id))
SELECT i::INT AS i, j::INT AS j, round(sum(w * p * q) / sum(w) - sum(w * p) * sum(w * q) / (sum(w) * sum(w)) + CASE WHEN i = j THEN 0.001 ELSE 0 END, 7)::DOUBLE AS cov FROM w GROUP BY i, j""")
def weighted_mean_cov(spark, sf_dir):
    _, _, cov = moments.moments(_vectors(spark, sf_dir), "v", DIMS, weight=(F.col("label") + 1).cast("double"))
    return _cells(spark, cov + 0.001 * np.eye(DIMS))


def _cells(spark, cov):
    return spark.createDataFrame([(i, j, round(float(cov[i, j]), 7)) for i in range(DIMS) for j in range(DIMS)], "i int, j int, cov double")


@query()
def effective_rank(spark, sf_dir):
    """How many principal components hold nine tenths of the variance."""
    _, _, cov = moments.moments(_vectors(spark, sf_dir), "v", DIMS)
    return spark.createDataFrame([(moments.effective_rank(np.linalg.eigvalsh(cov), 0.9),)], "eff_rank long")


@query(f"""WITH {_X}, p AS (SELECT label, count(*)::DOUBLE / sum(count(*)) OVER () AS prior FROM embeddings GROUP BY label)
SELECT label, i::INT AS i, round(avg(y), 6) AS mu, round(stddev_samp(y), 6) AS sd, round(prior, 6)::DOUBLE AS prior FROM x JOIN p USING (label) GROUP BY label, i, prior""")
def nbayes_fit(spark, sf_dir):
    fitted = models.fit_naive_bayes(_vectors(spark, sf_dir), "label", "v", DIMS)
    cells = fitted.select("label", "prior", F.posexplode(F.arrays_zip("mu", "sd")).alias("i", "c"))
    return cells.select("label", "i", F.round("c.mu", 6).alias("mu"), F.round("c.sd", 6).alias("sd"), F.round("prior", 6).alias("prior"))


_NB = f"""{_X}, m AS (SELECT label, i, avg(y) AS mu, stddev_samp(y) AS sd FROM x GROUP BY 1, 2), pr AS (SELECT label, count(*)::DOUBLE / sum(count(*)) OVER () AS prior FROM embeddings GROUP BY label),
l AS (SELECT x.vec_id, x.label AS truth, m.label AS pred, ln(prior) + sum(-ln(sd) - pow((y - mu) / sd, 2) / 2) - {DIMS // 2} * ln(2 * pi()) AS ll FROM x JOIN m USING (i) JOIN pr ON pr.label = m.label GROUP BY x.vec_id, x.label, m.label, prior),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ll DESC, pred) AS r FROM l), nb AS (SELECT vec_id, truth, pred, ll FROM b WHERE r = 1)"""


def _predicted(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    model = models.fit_naive_bayes(v, "label", "v", DIMS)
    return models.predict_naive_bayes(v, "vec_id", "v", model, "label", DIMS).join(v.select("vec_id", F.col("label").alias("truth")), "vec_id")


@query(f"WITH {_NB} SELECT vec_id, pred, round(ll, 5) AS ll FROM nb")
def nbayes_predict(spark, sf_dir):
    return _predicted(spark, sf_dir).select("vec_id", "pred", F.round("ll", 5).alias("ll"))


@query(f"WITH {_NB}, k AS (SELECT DISTINCT label FROM embeddings) SELECT a.label AS truth, b.label AS pred, count(nb.vec_id)::BIGINT AS n FROM k a CROSS JOIN k b LEFT JOIN nb ON nb.truth = a.label AND nb.pred = b.label GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return models.confusion(_predicted(spark, sf_dir), "truth", "pred")


_QT = "q AS (SELECT doc_id, quality, CASE WHEN length(text) % 3 > 0 THEN 0.8 ELSE 0.2 END AS score FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {_QT}, c AS (SELECT count(*) FILTER (WHERE score > 0.5 AND quality = 1)::DOUBLE AS tp, count(*) FILTER (WHERE score > 0.5 AND quality <> 1)::DOUBLE AS fp, count(*) FILTER (WHERE score <= 0.5 AND quality = 1)::DOUBLE AS fn, count(*)::DOUBLE AS n, count(*) FILTER (WHERE (score > 0.5) = (quality = 1))::DOUBLE AS ok FROM q) SELECT round(ok / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f FROM c")
def class_report(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    scored = joined.select("quality", F.when(F.length("text") % 3 > 0, 0.8).otherwise(0.2).alias("score"))
    return models.report(scored, "quality", "score").select(*(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f")))


@query("SELECT round(avg(CASE WHEN p_size = (p_partkey % 50) THEN 100.0 ELSE 0.0 END), 6)::DOUBLE AS acc, round(avg((p_size - p_partkey % 50) * (p_size - p_partkey % 50)), 6)::DOUBLE AS mse, round(pow(corr(p_size, p_partkey % 50), 2), 6) AS scc FROM part")
def regression_eval(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_size", (F.col("p_partkey") % 50).alias("said"))
    return models.regression_report(rows, "p_size", "said").select(*(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("acc", "mse", "scc")))


def _chances(spark, sf_dir):
    """Chances of three labels by a rule, a row for each label."""
    k = F.col("vec_id")
    raw = F.array(1 + k % 7, 1 + k % 11, 1 + k % 13)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(raw).alias("label", "w"), (3 + k % 7 + k % 11 + k % 13).alias("all"))
    return rows.select("vec_id", "label", (F.col("w") / F.col("all")).alias("p"))


_CH = "p AS (SELECT vec_id, unnest([0, 1, 2]) AS label, unnest([1 + vec_id % 7, 1 + vec_id % 11, 1 + vec_id % 13])::DOUBLE / (3 + vec_id % 7 + vec_id % 11 + vec_id % 13) AS p FROM embeddings)"


@query(f"WITH {_CH}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS k FROM p), m AS (SELECT vec_id, max(p) - min(p) AS margin FROM r WHERE k <= 2 GROUP BY 1) SELECT vec_id, round(margin, 6) AS margin FROM m ORDER BY m.margin, vec_id LIMIT 5")
def active_margin(spark, sf_dir):
    return models.query_by_margin(_chances(spark, sf_dir), "vec_id", "label", "p", 5).select("vec_id", F.round("margin", 6).alias("margin"))


@query(f"WITH {_CH}, m AS (SELECT vec_id, max(p) AS top FROM p GROUP BY 1) SELECT vec_id, round(top, 6) AS top FROM m ORDER BY m.top, vec_id LIMIT 5")
def active_least_confident(spark, sf_dir):
    return models.query_least_confident(_chances(spark, sf_dir), "vec_id", "p", 5).select("vec_id", F.round("top", 6).alias("top"))


@query(f"WITH {_CH} SELECT count(*)::BIGINT AS n, round(max(bits), 6) AS most FROM (SELECT vec_id, sum(-p * log2(p)) AS bits FROM p GROUP BY 1 ORDER BY bits DESC LIMIT 5)")
def active_entropy(spark, sf_dir):
    return models.query_by_entropy(_chances(spark, sf_dir), "vec_id", "p", 5).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("bits"), 6).alias("most"))


@query()
def cross_validation_folds(spark, sf_dir):
    return models.folds(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", 10)


@query()
def pca_scores(spark, sf_dir):
    full = table(spark, sf_dir, "embeddings")
    model = moments.principal_components(full, "embedding", 64, 0.9)
    return moments.score_anomalies(full, "vec_id", "embedding", model)


@query()
def sketched_svd(spark, sf_dir):
    values, _ = factors.sketched_svd(table(spark, sf_dir, "embeddings"), "embedding", 64, 5)
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(values)], "i int, singular double")


def _features(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    return _vectors(spark, sf_dir).withColumn("features", array_to_vector("v"))


@query()
def kmeans(spark, sf_dir):
    from pyspark.ml.clustering import KMeans

    rows = _features(spark, sf_dir)
    return KMeans(k=5, seed=1).fit(rows).transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


@query(f"""WITH c AS (SELECT label AS code, [{", ".join(f"avg(embedding[{i + 1}])" for i in range(DIMS))}] AS mu FROM embeddings GROUP BY label),
d AS (SELECT vec_id, code, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(embedding::DOUBLE[], mu::DOUBLE[]), 9), code) AS r FROM embeddings, c) SELECT vec_id, code FROM d WHERE r = 1""")
def quantize(spark, sf_dir):
    from quern.functions.arrays import distance

    rows = _vectors(spark, sf_dir)
    book = rows.groupBy(F.col("label").alias("code")).agg(F.array(*(F.avg(F.col("v")[i]) for i in range(DIMS))).alias("mu"))
    far = F.round(distance(F.col("v"), F.col("mu")), 9)
    return rows.crossJoin(F.broadcast(book)).groupBy("vec_id").agg(F.min_by("code", F.struct(far, F.col("code"))).alias("code"))


@query()
def gmm(spark, sf_dir):
    from pyspark.ml.clustering import GaussianMixture

    rows = _features(spark, sf_dir)
    return GaussianMixture(k=3, seed=1, maxIter=20).fit(rows).transform(rows).select("vec_id", F.col("prediction").alias("component"))


@query()
def mlr(spark, sf_dir):
    from pyspark.ml.classification import LogisticRegression

    rows = models.class_weights(_features(spark, sf_dir), "label")
    model = LogisticRegression(family="multinomial", labelCol="label", weightCol="weight", regParam=0.01, maxIter=30).fit(rows)
    return model.transform(rows).select("vec_id", "label", F.col("prediction").cast("int").alias("pred"))


@query()
def linear_svm(spark, sf_dir):
    from pyspark.ml.classification import LinearSVC, OneVsRest

    rows = _features(spark, sf_dir)
    model = OneVsRest(classifier=LinearSVC(maxIter=3, regParam=0.1)).fit(rows)
    return model.transform(rows).select("vec_id", "label", F.col("prediction").cast("int").alias("pred"))


def _by_label(method):
    """Residuals of a factorisation of each label's vectors, a label at a time; a label's vectors must fit in one task."""
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = np.array(group["v"].tolist())
        low, aside = method(x)
        return pd.DataFrame({"vec_id": group["vec_id"], "label": group["label"], "residual": np.sqrt(((x - low) ** 2).sum(axis=1)), "outlying": np.abs(aside).sum(axis=1)})

    return run


_SCORES = "vec_id long, label int, residual double, outlying double"


@query()
def rpca(spark, sf_dir):
    return _vectors(spark, sf_dir).groupBy("label").applyInPandas(_by_label(lambda x: factors.robust_pca(x, steps=100)), _SCORES)


@query()
def drmf(spark, sf_dir):
    return _vectors(spark, sf_dir).groupBy("label").applyInPandas(_by_label(lambda x: factors.direct_robust_factorisation(x, 2, 0.02, steps=50)), _SCORES)


@query()
def grouped_mixture(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    model = mixtures.fit_group_mixture(rows, "label", "v", DIMS, 2, 3, steps=5)
    return mixtures.score_groups(rows, "label", "v", DIMS, model)


@query("SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) AS r FROM embeddings) WHERE r <= 20")
def truncate_classes(spark, sf_dir):
    return models.truncate_classes(table(spark, sf_dir, "embeddings"), "label", "vec_id", 20).select("vec_id", "label")


@query()
def multinomial_draws(spark, sf_dir):
    return models.draw_multinomial(spark, {"a": 1, "b": 2, "c": 3, "d": 4}, 10_000)


@query()
def gmm_select(spark, sf_dir):
    _, scores = mixtures.select_mixture(_features(spark, sf_dir).cache(), "features", DIMS, [2, 3])
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(scores.items())], "k int, criterion double")


@query()
def factor_models(spark, sf_dir):
    """Squared errors of rank-2 factorisations of each label's vectors."""
    import pandas as pd

    methods = {"least_squares": factors.alternating_least_squares, "nonnegative": factors.nonnegative_factors, "svd": factors.svd_factors}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = np.abs(np.array(group["v"].tolist()))
        errors = {n: float(((x - (f := m(x, 2))[0].T @ f[1]) ** 2).sum()) for n, m in methods.items()}
        return pd.DataFrame([{"label": group["label"].iloc[0]} | errors])

    return _vectors(spark, sf_dir).groupBy("label").applyInPandas(run, "label int, " + ", ".join(f"{n} double" for n in methods))
