"""Fixed examples with known results."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import arrays, scores
from quern.operators import factors, graphs, intervals, mixtures, moments, neighbours, ranking, relational

EXPOSURES = [(0, 0, 0, 4), (0, 0, 5, 9), (1, 0, 1, 5), (1, 1, 6, 10), (1, 2, 11, 12), (2, 2, 0, 4), (2, 1, 2, 7)]
CONDITIONS = [(0, 0, 1), (0, 0, 2), (0, 0, 6), (1, 0, 0), (1, 0, 8), (2, 1, 3), (2, 1, 8), (2, 0, 9)]
EXPECTED = {
    (0, 0): (3, 1, 3, 4, 0.266268, 0.559605), (0, 1): (0, 4, 2, 4, -0.955511, -10.414342), (1, 0): (1, 1, 5, 4, -0.058841, -0.105362),
    (1, 1): (1, 1, 1, 7, 0.510826, 1.386231), (2, 0): (0, 2, 6, 3, -1.157453, -11.107474), (2, 1): (1, 1, 1, 7, 0.510826, 1.386231),
}


def frames(spark, x=EXPOSURES, c=CONDITIONS):
    return spark.createDataFrame(x, "person int, drug int, s int, e int"), spark.createDataFrame(c, "person int, cond int, t int")


def test_contingency_example(spark):
    counts = intervals.contingency(*frames(spark))
    w = [F.col(c) for c in ("w00", "w01", "w10", "w11")]
    rows = counts.select("*", scores.information_component(*w).alias("ic"), scores.log_reporting_ratio(*w).alias("prr")).collect()
    assert {(r.drug, r.cond): (r.w00, r.w01, r.w10, r.w11, round(r.ic, 6), round(r.prr, 6)) for r in rows} == EXPECTED


def naive_counts(x, c, sw):
    """Unit by unit: pairs that occur together, and exposures and occurrences alone."""
    pairs = [(d, k) for p, d, s, e in x for q, k, t in c if p == q and s <= t <= e + sw]
    alone = [d for p, d, s, e in x if not any(p == q and s <= t <= e + sw for q, _, t in c)]
    single = [k for q, k, t in c if not any(p == q and s <= t <= e + sw for p, _, s, e in x)]
    total = len(pairs) + len(alone) + len(single)
    out = {}
    for d in {r[1] for r in x}:
        for k in {r[1] for r in c}:
            both = pairs.count((d, k))
            row = sum(a == d for a, _ in pairs) + alone.count(d)
            col = sum(b == k for _, b in pairs) + single.count(k)
            hit = sum(any(p == q and a == d and s <= t <= e for p, a, s, e in x) for q, b, t in c if b == k)
            out[d, k] = (both, row - both, sum(b == k for _, b, _ in c) - hit, total - row - col + both)
    return out


@settings(max_examples=3, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(0, 9), st.integers(0, 4)), min_size=1, max_size=8),
    st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1), st.integers(0, 12)), min_size=1, max_size=8),
    st.sampled_from([0, 2]),
)
def test_contingency_unit_by_unit(spark, x, c, sw):
    x = [(p, d, s, s + n) for p, d, s, n in x]
    rows = intervals.contingency(*frames(spark, x, c), F.lit(sw)).collect()
    assert {(r.drug, r.cond): (r.w00, r.w01, r.w10, r.w11) for r in rows} == naive_counts(x, c, sw)


def test_average_precision(spark):
    df = spark.createDataFrame(list(zip([0.9, 0.8, 0.8, 0.5, 0.5, 0.1], [1, 0, 1, 1, 0, 0])), "score double, label int")
    assert round(ranking.tie_aware_precision(df, "score", "label").first()[0], 6) == 0.755556
    plain = spark.createDataFrame(list(zip([1.0, 2.0, 3.0, 4.0, 5.0], [1, 1, 0, 0, 1])), "score double, label int")
    points = ranking.precision_recall(plain, "score", "label", []).collect()
    assert round(sum(p.prec * p.label for p in points) / 3, 6) == 0.7


def test_quantile_entropy_and_kth(spark):
    one = spark.range(1, 7).select(F.col("id").cast("double").alias("x"))
    got = ranking.nearest_rank(one, "x", [0, 0.1, 0.3, 0.5, 0.9, 1]).orderBy("q").collect()
    assert [r.value for r in got] == [1, 1, 3, 3, 5, 6]
    row = spark.range(1).select(
        arrays.entropy_bits(F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25))).alias("e"),
        arrays.kth_smallest(F.array(F.lit(3), F.lit(1), F.lit(2)), 0).alias("k"),
        arrays.kth_smallest(F.array(F.lit(3), F.lit(1), F.lit(2)), 3).alias("none"),
        arrays.normalized(F.array(F.lit(4.0), F.lit(5.0), F.lit(6.0)), "m0v1").alias("n"),
    ).first()
    assert (row.e, row.k, row.none, row.n) == (1.5, 1, None, [-1.0, 0.0, 1.0])


def test_encode_and_accumulate(spark):
    a = spark.createDataFrame(list(enumerate([0, 0, 1, 2, 1, 3])), "at int, v int")
    book = spark.createDataFrame([(2, 0, "a"), (1, 1, "b"), (0, 2, "cd")], "k int, pos int, val string")
    assert [r.code for r in relational.encode(a, "v", book, "k", "pos").orderBy("at").collect()] == [2, 2, 1, 0, 1, -1]
    said = relational.encode_values(a, "v", book, "k", "pos", "val", "#").orderBy("at").collect()
    assert [r.attached for r in said] == ["cd", "cd", "b", "a", "b", "#"]
    base = spark.createDataFrame([(i, 0.0) for i in range(4)], "v int, b double")
    assert [r.acc for r in relational.accumulate(a, "v", F.lit(1.0), base, "b", "sum").orderBy("v").collect()] == [2, 2, 1, 1]


def test_grid_neighbours(spark):
    grid = spark.range(2500).select("id", (F.col("id") % 50).cast("double").alias("x"), F.floor(F.col("id") / 50).cast("double").alias("y"))
    edges = neighbours.radius_join(grid, "id", ["x", "y"], 1.2)
    counts = {r.src: r["count"] for r in edges.groupBy("src").count().where("src in (0, 10, 225)").collect()}
    assert counts == {0: 3, 10: 4, 225: 5} and edges.count() == 12300
    near = neighbours.exact_neighbours(grid.select("id", F.array("x", "y").alias("v")), grid.select("id", F.array("x", "y").alias("v")), "id", "v", 5)
    assert near.agg(F.sum("dist")).first()[0] == pytest.approx(10085.185858, abs=1e-5)


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = graphs.connected_components(spark.range(303), edges).groupBy("component").count().collect()
    assert {r.component: r["count"] for r in found} == {0: 301, 301: 1, 302: 1}


def test_factorisations():
    rng = np.random.default_rng(0)
    true = rng.standard_normal((60, 5)) @ rng.standard_normal((5, 50))
    spikes = np.where(rng.random(true.shape) < 0.01, rng.uniform(5, 15, true.shape), 0)
    assert np.sqrt(((factors.robust_pca(true + spikes)[0] - true) ** 2).mean()) < 1e-4
    assert np.sqrt(((factors.direct_robust_factorisation(true + spikes, 5, 0.02)[0] - true) ** 2).mean()) < 1e-2
    x = rng.random((100, 100))
    for u, v in (factors.alternating_least_squares(x, 5, 3), factors.nonnegative_factors(x, 5, 3), factors.svd_factors(x, 5)):
        assert ((x - u.T @ v) ** 2).sum() < 800
    online = factors.OnlineFactors(5, 50)
    for _ in range(20):
        online.update(true)
    assert np.abs(true - online.coefficients(true) @ online.d).mean() < 0.05
    assert moments.effective_rank(np.array([1.0, 0, 0, 1]), 0.99) == 2


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_is_cheapest(m, n, seed):
    from itertools import permutations

    cost = np.random.default_rng(seed).integers(0, 50, (m, n)).astype(float)
    got = factors.assignment(cost)
    total = sum(cost[i, j] for i, j in got)
    tall = cost if m <= n else cost.T
    assert len(got) == min(m, n)
    assert total == min(sum(tall[i, p[i]] for i in range(len(tall))) for p in permutations(range(tall.shape[1]), len(tall)))


def test_principal_components_and_sketch(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 6)) * [5, 3, 1, 0.1, 0.1, 0.1] + 2
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    n, mean, cov = moments.moments(df, "v", 6)
    assert n == 200 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True))
    model = moments.principal_components(df, "v", 6, 0.99)
    assert model.rank == 3
    values, _ = factors.sketched_svd(df, "v", 6, 3)
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:3])


def test_group_mixture_finds_the_odd_group(spark):
    rng = np.random.default_rng(2)
    rows = [(g, (rng.standard_normal(2) * 0.3 + ((3, 3) if g == 9 else ((0, 0), (1, 1))[rng.integers(2)])).tolist()) for g in range(10) for _ in range(40)]
    df = spark.createDataFrame(rows, "g int, v array<double>")
    model = mixtures.fit_group_mixture(df.where("g < 9"), "g", "v", 2, 2, 2, steps=8)
    scored = mixtures.score_groups(df, "g", "v", 2, model).orderBy(F.col("ll") / F.col("rows")).collect()
    assert scored[0].g == 9 and len(scored) == 10


def test_mixture_selection(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(3)
    x = np.vstack([rng.standard_normal((150, 2)) * 0.1 + m for m in ((0, 1), (1, 0), (0, 0))])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").select(array_to_vector("v").alias("f"))
    assert mixtures.select_mixture(df, "f", 2, [2, 3])[0] == 3


def test_multinomial_and_smoothing(spark):
    from quern.operators import models, spectra

    counts = {r.value: r["count"] / 20000 for r in models.draw_multinomial(spark, {"a": 1, "b": 2, "c": 3, "d": 4}, 20000).groupBy("value").count().collect()}
    assert all(abs(counts[v] - p) < 0.01 for v, p in zip("abcd", (0.1, 0.2, 0.3, 0.4)))
    line = [float(2 * i + 1) for i in range(10)]
    df = spark.createDataFrame([(1, line), (2, [0.0, 1.0] * 5)], "id int, v array<double>")
    got = {r.id: r.resampled for r in spectra.smooth_resample(df, "id", "v", 10, 19).collect()}
    assert np.allclose(got[1], [1 + i for i in range(19)])
    assert np.std(got[2]) < 0.3
