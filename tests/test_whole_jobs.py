"""Queries do the whole job: nothing hard-coded, cut or left out."""

import time
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import registry
from quern.functions import arrays, scores
from quern.operators import graphs, models, neighbours, ranking
from quern.plans import storage
from quern.registry import table
from tests.compare import assert_same, database


def test_file_key_comes_from_the_files(spark, sf, monkeypatch):
    query = registry.queries()["file_key"]
    assert_same(database(sf), query(spark, sf), registry.oracle_sql()["file_key"])
    keyed = storage.text.with_file_key
    monkeypatch.setattr(storage.text, "with_file_key", lambda df, length: keyed(df, length + 2))
    assert {r.file_key for r in query(spark, sf).collect()} == {"orders"}


WHOLE = """weighted_mean_cov nbayes_fit normalize_01_row normalize_pm1_row normalize_s1_row normalize_m0_row normalize_v1_row
normalize_n1_row""".split()


@pytest.mark.parametrize("name", WHOLE)
def test_whole_vectors_against_sql(spark, sf, name):
    sql = registry.oracle_sql()[name]
    assert "1:8" not in sql and "1:4" not in sql
    if not name.startswith("normalize_m0_"):
        return assert_same(database(sf), registry.queries()[name](spark, sf), sql)
    # By value: a mean taken off can leave -0.0.
    got = {(r.vec_id, r.i): r.x for r in registry.queries()[name](spark, sf).collect()}
    assert got == {(k, i): x for k, i, x in database(sf).sql(f"SELECT vec_id, i, x FROM ({sql})").fetchall()}


def test_whole_vectors_against_numpy(spark, sf):
    rows = table(spark, sf, "embeddings").collect()
    x, label = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])
    run = lambda name: registry.queries()[name](spark, sf).collect()
    square = lambda name: np.array([r["cov"] for r in sorted(run(name))]).reshape(64, 64)
    cov = np.cov(x.T, bias=True)
    assert np.allclose(square("mean_cov"), cov, atol=2e-7)
    assert np.allclose(square("weighted_mean_cov"), np.cov(x.T, bias=True, aweights=label + 1) + 0.001 * np.eye(64), atol=2e-7)
    energy = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    assert run("effective_rank")[0][0] == (np.cumsum(energy) / energy.sum() <= 0.9).sum() + 1
    got = {r.label: r for r in run("factor_models")}
    for k in np.unique(label):
        left = np.linalg.svd(np.abs(x[label == k]), compute_uv=False)[2:]
        assert np.isclose(got[k].svd, (left**2).sum())


NO_SQL = "kmeans gmm gmm_select mlr linear_svm rpca drmf grouped_mixture factor_models".split()


@pytest.mark.parametrize("name", NO_SQL)
def test_last_components_count(spark, sf, tmp_path, name):
    """Other values beyond the first 8 components change the result."""
    v = F.transform("embedding", lambda x, i: F.when(i < 8, x).otherwise(x * (1 + F.col("vec_id") % 3)).cast("float"))
    table(spark, sf, "embeddings").withColumn("embedding", v).write.parquet(f"{tmp_path}/embeddings.parquet")
    got, other = (sorted(map(tuple, registry.queries()[name](spark, d).collect())) for d in (sf, str(tmp_path)))
    assert len(got) == len(other) and got != other


@pytest.mark.parametrize("name, n", [("flatten_once", None), ("combinations", 25 * 24 * 23 // 6)])
def test_no_subset(spark, sf, name, n):
    df = registry.queries()[name](spark, sf)
    assert df.count() == (n or 3 * table(spark, sf, "events").count())
    assert_same(database(sf), df, registry.oracle_sql()[name])


def test_components_by_one_task_and_by_stars(spark, monkeypatch):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(i, i + 1) for i in range(500, 540)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    one = sorted(graphs.component_roots(frame).collect())
    monkeypatch.setattr(graphs, "SMALL_EDGES", 0)
    assert one == sorted(graphs.component_roots(frame).collect()) and len(one) > 100


def _lone_windows(df):
    """Windows over all rows of a table: those that have no partition but more than a row for each range."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [w for w in plan.splitlines() if "Window " in w and "_range" not in w]


@pytest.mark.parametrize("values, up, down", [([1, 2, 2, 9], True, False), ([3, 1], False, True), ([1, None, 0], True, True), ([], None, None), ([5], True, True)])
def test_sortedness_of_ranges(spark, values, up, down):
    df = spark.createDataFrame(list(enumerate(values)), "at int, v int")
    assert ranking.is_sorted(df, [F.col("at")], "v").first()[0] is up
    assert ranking.is_sorted(df, [F.col("at")], "v", descending=True).first()[0] is down


@pytest.mark.parametrize("wrong", [None, 1, 250, 500, 999])
def test_one_fall_is_seen_in_any_range(spark, wrong):
    df = spark.range(1000).select("id", F.when(F.col("id") == F.lit(wrong), F.lit(-1)).otherwise(F.col("id")).alias("v"))
    assert ranking.is_sorted(df, [F.col("id")], "v").first()[0] is (wrong is None)


def test_whole_orders_take_no_single_task(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(s), int(y)) for i, (s, y) in enumerate(zip(rng.integers(0, 40, 500), rng.integers(0, 2, 500), strict=True))]
    df = spark.createDataFrame(rows, "id int, score double, label int")
    points = ranking.precision_recall(df, "score", "label", ["id"])
    hits = np.cumsum([y for _, _, y in sorted(rows, key=lambda r: (-r[1], r[0]))])
    got = {r.k: (r.prec, r.recall) for r in points.collect()}
    assert got == {k: (h / k, h / hits[-1]) for k, h in enumerate(hits.tolist(), 1)}
    found = models.folds(df, "id", 7)
    sizes = sorted(r["count"] for r in found.groupBy("fold").count().collect())
    assert sizes == [68, 72, 72, 72, 72, 72, 72] and sorted(r.id for r in found.collect()) == list(range(500))
    assert not _lone_windows(points) and not _lone_windows(found)
    empty = df.where("false")
    assert not ranking.precision_recall(empty, "score", "label", ["id"]).count() and not models.folds(empty, "id", 7).count()


@pytest.mark.parametrize("name", ["position_join", "risk_levels"])
def test_new_queries_against_sql(spark, sf, name):
    assert_same(database(sf), registry.queries()[name](spark, sf), registry.oracle_sql()[name])


def test_pairs_that_never_occur_rank_below_by_keys(spark, sf):
    query = registry.queries()["bcpnn_ranked"]
    got = {(r.drug, r.cond): (r.w00, r.score) for r in query(spark, sf).collect()}
    supported = {(r.drug, r.cond): r.score for r in registry.queries()["bcpnn_supported"](spark, sf).collect()}
    assert {k: round(s, 6) for k, (n, s) in got.items() if n > 0} == pytest.approx(supported)
    pairs = spark.createDataFrame([(d, c) for d in range(20) for c in range(20)], "drug int, cond int")
    low = pairs.select(scores.ranked_where_unsupported(F.lit(None).cast("double"), F.lit(0.0), F.col("drug"), F.col("cond")).alias("s"))
    values = [r.s for r in low.collect()]
    assert all(-2 < v <= -1 for v in values) and len(set(values)) > 390 and values == [r.s for r in low.collect()]
    assert all(-2 < s <= -1 for n, s in got.values() if n == 0)


@pytest.mark.parametrize("mode", ["v1", "m0v1"])
def test_rows_are_normalized_in_linear_time(spark, mode):
    x = np.random.default_rng(5).random((24, 320))
    df = spark.createDataFrame([([],), *((r.tolist(),) for r in x)], "v array<double>").coalesce(1).cache()
    df.count()
    start = time.time()
    got = [r[0] for r in df.select(arrays.normalized(F.col("v"), mode)).collect()]
    assert time.time() - start < 6
    shift = x.mean(axis=1, keepdims=True) if mode == "m0v1" else 0
    assert got[0] == [] and np.allclose(got[1:], (x - shift) / x.std(axis=1, ddof=1, keepdims=True))


def test_components_of_near_rows_without_their_pairs(spark, monkeypatch):
    """As from all pairs; crowds, gaps, missing numbers and repeated keys included."""
    rng = np.random.default_rng(9)
    crowd = [(rng.random((60, 2)) + [4.0 * k, 0]) * [1, 0.3] for k in range(6)]
    x = np.concatenate([rng.random((400, 2)) * 40 + 100, *crowd, rng.integers(0, 60, (300, 2)) - 200.0])
    rows = [(i * 7 % 100_003, *map(float, p)) for i, p in enumerate(x)]
    rows += [(200_001, None, 1.0), (200_002, float("inf"), 1.0), (200_003, 1.0, None), (rows[3][0], 900.0, 900.0), (rows[500][0], 901.0, 900.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    ends = df.where("abs(x) < double('infinity') and y is not null")
    for radius in (1.0, 2.0, 3.3):
        edges = neighbours.radius_join(ends, "id", ["x", "y"], radius).select("src", "dst")
        want = graphs.connected_components(df.select("id"), edges).collect()
        with monkeypatch.context() as m:
            m.setattr(neighbours, "_grid_pairs", None)
            got = neighbours.near_components(df, "id", ["x", "y"], radius).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_crowded_cells_are_compared_row_by_row(spark):
    """Two cells whose extreme rows are too far apart, but that two inner rows link."""
    points = [(0.0, 0.35), (0.1, 0.0), (0.1, 0.70), (0.05, 0.3), (1.41, 0.35), (1.4, 0.0), (1.4, 0.70), (1.30, 0.3)]
    points += [(0.30, 0.32), (1.299, 0.33)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, x double, y double")
    edges = neighbours.radius_join(df, "id", ["x", "y"], 1.0).select("src", "dst")
    want = graphs.connected_components(df.select("id"), edges).collect()
    got = neighbours.near_components(df, "id", ["x", "y"], 1.0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_distances_are_summed_without_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i % 3 if i % 7 else None, *map(float, p)) for i, p in enumerate(rng.random((300, 2)) * 6 - 3)] + [(1, None, 0.0)]
    df = spark.createDataFrame(rows, "label long, x double, y double").withColumn("id", F.monotonically_increasing_id())
    named = df.select("id", "label")
    edges = neighbours.radius_join(df, "id", ["x", "y"], 1.0).join(named.toDF("src", "a"), "src").join(named.toDF("dst", "b"), "dst")
    want = {(r.a, r.b): r.dist for r in graphs.adjacency(edges, "a", "b", "dist").collect()}
    monkeypatch.setattr(neighbours, "_grid_pairs", None)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    got = {(r.a, r.b): r.dist for r in neighbours.label_distances(df, "label", ["x", "y"], 1.0).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], rtol=1e-12) for k in want)


def _crowd():
    """A crowded cell, a few rows around it, missing numbers, and a difference that rounds down to 1."""
    rng = np.random.default_rng(6)
    points = [*(rng.random((300, 2)) * 0.9 + 5), *(rng.random((60, 2)) * 6 + 3), (1 - 2.0**-53, -9.0), (2.0, -9.0)]
    rows = [(i, *map(float, p)) for i, p in enumerate(points)]
    return rows, [*rows, (900, None, 5.0), (901, 5.0, None), (902, float("nan"), 5.0), (903, float("inf"), 5.0)]


def _in_tasks(df):
    """Rows, and how many tasks give any."""
    rows = df.withColumn("task", F.spark_partition_id()).collect()
    return [tuple(r)[:-1] for r in rows], len({r.task for r in rows})


def test_pairs_of_a_crowded_cell_come_from_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 16)
    rows, every = _crowd()
    df = spark.createDataFrame(every, "id long, x double, y double").coalesce(1)
    got, tasks = _in_tasks(neighbours.radius_join(df, "id", ["x", "y"], 1.0))
    x = np.array([r[1:] for r in rows])
    square = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert sorted(got) == [(a, b, float(np.sqrt(square[a, b]))) for a, b in np.argwhere(square <= 1).tolist()]
    assert tasks == 4


def test_boxes_of_a_crowded_cell_come_from_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 16)
    rows, every = _crowd()
    df = spark.createDataFrame(every, "id long, x double, y double").coalesce(1)
    got, tasks = _in_tasks(neighbours.box_join(df, "id", {"x": 1.0, "y": 0.5}))
    x = np.array([r[1:] for r in rows])
    near = (np.abs(x[:, None] - x[None]) <= [1.0, 0.5]).all(axis=2)
    assert sorted(got) == [tuple(p) for p in np.argwhere(near).tolist()] and (360, 361) in got
    assert tasks == 4


def _joined_rows(df):
    """Rows that the joins of an executed plan gave."""
    total, nodes = 0, [df._jdf.queryExecution().executedPlan().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("SortMergeJoin"):
            total += node.metrics().apply("numOutputRows").value()
        if node.nodeName() == "ResultQueryStage":
            nodes.append(node.plan())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_boxes_meet_rows_with_lists(spark, monkeypatch):
    """A step of the join is a row and a list, not a pair, of numbers of all kinds; keys may be missing or shared."""
    rows, every = _crowd()
    df = spark.createDataFrame([*every, (7, 5.5, 5.5), (None, 5.5, 5.5)], "id long, x double, y double")
    pairs = neighbours.box_join(df, "id", {"x": 1.0, "y": 0.5})
    found = pairs.count()
    got = pairs.collect()
    assert len(got) == found and 0 < _joined_rows(pairs) < found / 4
    monkeypatch.setattr(neighbours, "PART_ROWS", 16)
    monkeypatch.setattr(neighbours, "NEAR_ROWS", 3, raising=False)
    ids = [r[0] for r in rows] + [7, None]
    x = np.array([*(r[1:] for r in rows), (5.5, 5.5), (5.5, 5.5)])
    order = lambda found: sorted(tuple(r) for r in found if None not in tuple(r)) + [sum(None in tuple(r) for r in found)]
    want = order([(ids[a], ids[b]) for a, b in np.argwhere((np.abs(x[:, None] - x[None]) <= [1.0, 0.5]).all(axis=2))])
    assert order(got) == want == order(neighbours.box_join(df, "id", {"x": 1.0, "y": 0.5}).collect())
    # Exact in decimals, though not in doubles.
    tenth = df.where("x between -9999 and 9999").selectExpr("id", "cast(round(x * 10) as int) x", "cast(y as decimal(9,2)) y")
    data = {(r.id, r.x, r.y) for r in tenth.collect() if r.y is not None}
    want = sorted((a[0], b[0]) for a in data for b in data if None not in (a[0], b[0]) and abs(a[1] - b[1]) <= 3 and abs(a[2] - b[2]) <= Decimal("0.05"))
    got = neighbours.box_join(tenth.where("id is not null").distinct(), "id", {"x": 3, "y": 0.05}).collect()
    assert sorted(map(tuple, got)) == want and len(want) > 500


def test_buckets_are_compared_without_their_pairs(spark, sf, monkeypatch):
    """As approxSimilarityJoin, over one bucket or many, and at least 0.9 of what brute force finds."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(40, 6)), 3, axis=0) + rng.normal(size=(120, 6)) * 0.12
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, x[0].tolist()), (0, x[0].tolist()), (0, x[5].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    vectors = df.select("id", array_to_vector("v").alias("x"))
    model = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=0.5, numHashTables=6, seed=1).fit(vectors)
    want = model.approxSimilarityJoin(vectors, vectors, 0.6).select("datasetA.id", "datasetB.id", "distCol").collect()
    with monkeypatch.context() as m:
        m.setattr(BucketedRandomProjectionLSHModel, "approxSimilarityJoin", None)
        m.setattr(neighbours, "BUCKET_ROWS", 7, raising=False)
        got = neighbours.approximate_neighbours(df, "id", "v", 0.6).collect()
        found = {(r.src, r.dst) for r in registry.queries()["lsh_neighbours"](spark, sf).collect()}
    flat = lambda rows: sorted((a, b, round(d, 9)) for a, b, d in rows)
    assert flat(got) == flat(want) and len(got) > 250
    data = sorted(table(spark, sf, "embeddings").collect())
    v = np.array([r.embedding for r in data], float)
    near = np.argwhere(((v[:, None] - v[None]) ** 2).sum(axis=2) < 0.36)
    exact = {(data[a].vec_id, data[b].vec_id) for a, b in near}
    assert found <= exact and len(found) >= 0.9 * len(exact)


@pytest.mark.parametrize("again", [False, True])
def test_lists_of_neighbours_without_pairs_as_rows(spark, monkeypatch, again):
    """By distance to 9 places, then key; only rows that share a key go by pairs."""
    monkeypatch.setattr(neighbours, "LIST_ROWS", 16)
    rows, every = _crowd()
    same = [(7, *rows[40][1:]), (7, 20.0, 20.0)] if again else []
    if not again:
        monkeypatch.setattr(graphs, "neighbour_lists", lambda edges, *_: edges.where("false").groupBy("src").agg(F.collect_list(F.struct("dist", "dst")).alias("near")))
    df = spark.createDataFrame([*every, *same], "id long, x double, y double")
    ids, x = np.array([r[0] for r in rows + same]), np.array([r[1:] for r in rows + same])
    square = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = {}
    for a, b in np.argwhere(square <= 1).tolist():
        want.setdefault(int(ids[a]), []).append((round(float(np.sqrt(square[a, b])), 9), int(ids[b])))
    got = neighbours.radius_lists(df, "id", ["x", "y"], 1.0).collect()
    assert {r.src: r.near for r in got} == {k: [b for _, b in sorted(v)] for k, v in want.items()} and len(got) == len(want)
