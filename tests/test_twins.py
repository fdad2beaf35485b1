"""Queries against their SQL twins, once on the plain paths and once on the split paths."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.check import TABLES, same

PLAIN = ["rolling_mean", "profile_table", "quantile_bins", "roc_auc", "threshold_sweep", "target_encode_oof", "kfold", "psi", "km_curve", "hierarchy_rollup", "text_stats", "split_headers"]
SPLIT = ["lag_features", "lead_features", "rolling_by_time", "velocity_features", "fatigue_counts", "prediction_drift", "ffill", "interpolate_linear", "asof_join", "range_label_join", "run_length", "expanding_target_mean", "days_since_event", "radius_join",
         "knn_classify", "spatial_knn_mean", "knn_manhattan", "k_distance", "nearest_distance"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def compare(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert same(got, con.execute(entry.oracle_sql()[name]).df()) == ""


@pytest.mark.parametrize("name", PLAIN)
def test_plain(spark, con, name):
    compare(spark, con, name)


@pytest.mark.parametrize("name", SPLIT)
def test_split_path(spark, con, small_groups, name):
    compare(spark, con, name)


def test_registry_needs_no_session():
    assert set(entry.oracle_sql()) <= set(entry.queries())
