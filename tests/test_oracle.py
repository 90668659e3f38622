"""Queries against DuckDB on the smallest tables; the driver compares all of them on larger ones."""

import pytest

from quern import registry
from tests.compare import assert_same, database

NAMES = """interval_join cooc_threshold_grid contingency_2x2 contingency_incident bcpnn prr tie_aware_ap roc_points blend_rank as_of_join
encode_first encode_value_default not_in_list not_in_nulls outer_join_where probe_after_limit edges_dedup group_list dense_groups accum_sum accum_prod
quantile_nearest entropy normalize_m0v1_row normalize_01_col topn_portion even_sample dedup_keep_last calendar_functions sexagesimal_parse comoving_xyz
quality_chain masked_replace flux_rebin knn_exact radius_join box_join connected_components cluster_histogram mean_cov nbayes_predict confusion_matrix
quantize import_delimited replace_partition label_merge stream_tumbling stream_sessions""".split()


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf, con, name):
    assert_same(con, registry.queries()[name](spark, sf), registry.oracle_sql()[name])


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"], capture_output=True, text=True, cwd=__file__.rsplit("/", 2)[0])
    assert said.stdout.strip().endswith("True"), said.stderr
