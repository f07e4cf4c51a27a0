"""Every SQL-checked registered query against its DuckDB oracle (sf0.001)."""

import pytest

from obol.plans.oracle_sql import ORACLE
from obol.plans.queries import QUERIES
from tests.oracle_harness import compare, duck_connect

SF = "/root/testdata/sf0.001"
NAMES = [n for n in QUERIES if n in ORACLE]


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, SF)
    assert r["status"] == "ok", r.get("problems")


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


SKEW_PATH_QUERIES = ["client_history", "client_history_asof", "history_new_applications", "split_chronological",
                     "split_stratified", "split_three_way", "split_kfold", "undersample", "auc", "brier_aucpr",
                     "clean_loans", "client_outliers", "client_quantile_bins", "robust_scale", "knn_impute", "smote",
                     "default_rate_by_client_type"]


@pytest.mark.parametrize("name", SKEW_PATH_QUERIES)
def test_query_matches_oracle_on_range_path(spark, con, name):
    """Same queries with the per-task budget forced down to 40 rows, so the
    ordered groups (labels, the global order, clients, score and value
    distributions) take the range-bucket path."""
    import obol.operators.running as R
    saved = (dict(R.running.__kwdefaults__), R.MAX_HEAVY_KEYS)
    R.running.__kwdefaults__["max_group_rows"] = 40
    R.MAX_HEAVY_KEYS = 20
    try:
        r = compare(spark, con, name, SF)
    finally:
        R.running.__kwdefaults__.clear()
        R.running.__kwdefaults__.update(saved[0])
        R.MAX_HEAVY_KEYS = saved[1]
    assert r["status"] == "ok", r.get("problems")
