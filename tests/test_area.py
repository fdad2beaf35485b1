"""The area under the ROC curve as an evaluator, and how nested_cv holds its rows."""

import random

import pytest
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from larkspur.metrics.ranking import AreaUnderRoc
from larkspur.plans import learning


def brute(rows):
    pos, neg = ([(s, w) for s, y, w in rows if y == k] for k in (1.0, 0.0))
    won = sum(p * n * ((a > b) + (a == b) / 2) for a, p in pos for b, n in neg)
    return won / (sum(p for _, p in pos) * sum(n for _, n in neg))


@pytest.mark.parametrize("values", [4, 100_000])
def test_area_is_exact_over_batches_and_ranges(spark, values):
    rng = random.Random(values)
    rows = [(rng.randrange(values) / 7 - 3, float(rng.random() < .4), float(rng.randrange(1, 4))) for _ in range(3000)]
    df = spark.createDataFrame(rows + [(-0.0, 1.0, 1.0), (0.0, 0.0, 2.0)], "rawPrediction double, y double, w double").repartition(3)
    want = brute(rows + [(0.0, 1.0, 1.0), (0.0, 0.0, 2.0)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert abs(AreaUnderRoc(weight="w").evaluate(df) - want) < 1e-12
        plain = brute([(r.rawPrediction + 0.0, r.y, 1.0) for r in df.collect()])
        # a curve of 1,000 points would be some 1e-7 off
        assert abs(learning.auc(df) - plain) < 1e-12
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_area_where_a_class_is_missing_or_a_score_is_not_a_number(spark):
    made = lambda rows: spark.createDataFrame(rows, "rawPrediction double, y double")
    assert learning.auc(made([(.1, 1.0), (.2, 1.0)])) == 1.0 and learning.auc(made([(.1, 0.0), (.2, 0.0)])) == 0.0 and learning.auc(made([])) == .5
    nan = float("nan")
    assert learning.auc(made([(nan, 1.0), (nan, 0.0), (.2, 0.0)])) == .75


def test_nested_folds_hold_only_what_the_fits_read(spark, t, monkeypatch):
    seen = []

    class Seen(CrossValidator):
        def fit(self, dataset, params=None):
            seen.append(sorted(dataset.columns))
            assert not dataset.sparkSession.sparkContext._jsc.getPersistentRDDs().size() > 1
            return super().fit(dataset, params)

    spark.catalog.clearCache()
    monkeypatch.setattr(learning, "CrossValidator", Seen)
    got = learning.nested_cv(t).collect()
    assert seen == [["features", "inner", "outer", "y"]] * 3
    assert [r.fold for r in got] == [0, 1, 2] and all(r.chosen in (.001, .1) and .6 < r.auc < 1 for r in got)


def test_rows_are_dealt_evenly_over_the_cores(spark, monkeypatch):
    monkeypatch.setattr(learning, "PART_ROWS", 100)
    cores = spark.sparkContext.defaultParallelism
    parts = [learning.spread(spark.range(n), n).select(F.spark_partition_id()).distinct().count() for n in (10 * cores, 100 * cores + 1)]
    assert parts == [cores, 2 * cores]
