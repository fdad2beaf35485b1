"""Plan checks: no cartesian products, pruned and filtered scans."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from larkspur.functions.scalar import MIX_PRIME, POISSON1, mix_hash, poisson1
from larkspur.plans import learning
from larkspur.plans.learning import cls_vec
from larkspur.sources.tables import Tables
from tests.conftest import SF


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["rolling_mean", "roc_auc", "quantiles_exact", "asof_join", "target_encode_m", "cap_iqr", "tag_cooccurrence", "threshold_sweep", "km_curve", "knn_classify", "feature_join_wide", "psi"])
def test_no_cross_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_is_pruned_and_filtered(spark):
    text = plan(spark, "scan_table")
    assert re.search(r"PushedFilters: \[.*EqualTo\(event_type,purchase\)", text)
    assert "props" not in re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)


def test_one_shuffle_for_many_window_features(spark):
    text = plan(spark, "lag_features").split("== Physical Plan ==")[1]
    assert text.count("Exchange hashpartitioning") == 1


def test_a_row_hash_is_computed_once_in_a_filter(spark):
    rows = spark.range(200).selectExpr("id * 7919 AS id", "double(id) AS y")
    key = F.pmod(F.xxhash64("id", "y"), F.lit(1 << 40))
    kept = rows.filter(poisson1(mix_hash(key, 31)) > 0)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("48271") == 1 and plan.count("xxhash64") == 1
    m, got = MIX_PRIME, rows.select("id", mix_hash("id", 7).alias("u"), poisson1(mix_hash("id", 7)).alias("w")).collect()
    for r in got:
        low, high = r.id & m, (r.id >> 31) & m
        a = (low * 48271 + high * 69621 + 7 * 16807 + 1) % m
        c = ((a * a + 31 * a + high * 127773) % m * 69621 + a * 14) % m
        u = (c * c + 8191 * c + a) % m / m
        assert r.u == u and r.w == sum(u >= p for p in POISSON1)
    assert spark.range(1).select(mix_hash(F.lit(None).cast("bigint")).alias("u")).first().u is None


def test_vectors_for_fits_lie_on_every_core(spark):
    v = cls_vec(Tables(spark, SF))
    assert v.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_kernel_fit_has_no_more_parts_than_cores_for_few_rows(spark, monkeypatch):
    seen, fourier = [], learning.fourier
    monkeypatch.setattr(learning, "fourier", lambda df, *a, **k: seen.append(df.rdd.getNumPartitions()) or fourier(df, *a, **k))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("64", "false", "-1")):
        spark.conf.set(k, v)
    try:
        entry.queries()["kernel_svm_rff"](spark, SF)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert seen == [spark.sparkContext.defaultParallelism] * 3
