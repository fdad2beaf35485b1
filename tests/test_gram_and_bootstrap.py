"""Fits from cross products, pooled segments, bootstrap of the AUC and stored sketches against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from larkspur.metrics.bootstrap import bootstrap_auc, mix_numbers, poisson_weights
from larkspur.models import gram
from larkspur.operators.sketches import add_days, distinct_between, quantiles_between
from larkspur.plans.learning import bakeoff


@pytest.fixture(scope="module")
def lines(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2)) * [1, 50] + [3, 1000]
    y = x @ [2.0, -.1] + rng.normal(size=400)
    return spark.createDataFrame([(i, i % 4, i % 3, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))] + [(900, 0, 0, None, 1.0, 1.0)], "id int, f int, g int, a double, b double, y double"), x, y


def refit(x, y, p):
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z / len(x) + p * np.eye(x.shape[1]), z.T @ (y - y.mean()) / len(x)) / sd
    return np.concatenate([[y.mean() - w @ mean], w])


def test_folds_by_subtraction_equal_refitting(lines):
    df, x, y = lines
    f, g = np.arange(400) % 4, np.arange(400) % 3
    grams = gram.fold_grams(df, ["a", "b"], "y", ["f", "g"])
    by_f = {}
    for (a, _), m in grams.items():
        by_f[(a,)] = by_f.get((a,), 0) + m
    def score(p, rows, by):
        return math.sqrt(sum(((y[rows & (by == k)] - np.c_[np.ones((rows & (by == k)).sum()), x[rows & (by == k)]] @ refit(x[rows & (by != k)], y[rows & (by != k)], p)) ** 2).sum() for k in np.unique(by)) / rows.sum())
    everyone = np.ones(400, bool)
    for p, rmse in gram.ridge_path(by_f, [.001, 1.0, 10.0]):
        assert rmse == pytest.approx(score(p, everyone, f), rel=1e-6)
    for o, best, rmse in gram.nested_ridge(grams, [.001, 1.0, 10.0]):
        rest = f != o
        assert best == min([.001, 1.0, 10.0], key=lambda p: score(p, rest, g))
        w = refit(x[rest], y[rest], best)
        assert rmse == pytest.approx(math.sqrt(((y[~rest] - np.c_[np.ones((~rest).sum()), x[~rest]] @ w) ** 2).mean()), rel=1e-6)


def test_segments_thin_degenerate_null_and_unseen(spark):
    rows = [("a", float(i), 2.0 * i + 1) for i in range(200)] + [("b", 5.0, 100.0)] + [("c", 7.0, 10.0 + i) for i in range(30)] + [(None, float(i), 3.0 * i) for i in range(50)] + [("d", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    model = gram.pooled_segments(df, "g", ["x"], "y", prior=20.0)
    x, y = (np.array([r[i] for r in rows if r[1] is not None]) for i in (1, 2))
    z = np.c_[np.ones(len(x)), x]
    base = np.linalg.lstsq(z, y, rcond=None)[0]
    for r in model.collect():
        own = np.array([s != "d" and s == r.segment and v is not None for s, v, _ in rows])[: len(rows)][[v is not None for _, v, _ in rows]]
        want = base if r.is_all else np.linalg.solve(z[own].T @ z[own] + 20 * z.T @ z / len(x), z[own].T @ y[own] + 20 * z.T @ z / len(x) @ base)
        assert np.allclose(r.weights, want, atol=1e-6)
    ask = spark.createDataFrame([("new", 1.0), ("b", 1.0), (None, 1.0), ("d", 1.0)], "g string, x double")
    got = {r.g: r.p for r in gram.predict_segments(ask, model, "g", ["x"], "p").collect()}
    assert all(v is not None for v in got.values()) and got["new"] == got["d"] == pytest.approx(base.sum())
    assert gram.predict_segments(ask, gram.pooled_segments(df.filter("false"), "g", ["x"], "y"), "g", ["x"], "p").count() == 4


def test_bootstrap_auc_against_each_resample(spark):
    from larkspur.functions.scalar import mix_hash, poisson1
    rng = np.random.default_rng(6)
    n = 3000
    y = rng.integers(0, 2, n)
    s = np.round(y * .8 + rng.normal(size=n), 1)
    df = spark.createDataFrame([(int(i) * 7, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))] + [(1, None, 1), (None, 1.0, 0)], "id bigint, score double, y int")
    got = {r.rep: r.auc for r in bootstrap_auc(df, "id", "score", "y", 40).collect()}
    w = poisson_weights(np.arange(n) * 7, np.arange(40))
    for rep in range(40):
        p, q = w[:, rep] * y, w[:, rep] * (1 - y)
        won = sum(p[s == v].sum() * (q[s < v].sum() + q[s == v].sum() / 2) for v in np.unique(s))
        assert got[rep] == pytest.approx(won / (p.sum() * q.sum()), rel=1e-9)
    same = spark.range(500).select(mix_hash(F.col("id") * 12345678901, 9).alias("u"), poisson1(mix_hash(F.col("id") * 12345678901, 9)).alias("w")).collect()
    assert np.allclose([r.u for r in same], mix_numbers(np.arange(500) * 12345678901, np.array([9]))[:, 0])
    assert [r.w for r in same] == poisson_weights(np.arange(500) * 12345678901, np.array([9]))[:, 0].astype(int).tolist()


def test_interval_is_as_wide_as_theory(spark):
    rng = np.random.default_rng(8)
    n = 2000
    y = np.arange(n) % 2
    s = rng.normal(size=n) + y
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))], "id bigint, score double, y int")
    auc = [r.auc for r in bootstrap_auc(df, "id", "score", "y", 1000).collect()]
    pos, neg = s[y == 1], s[y == 0]
    v10 = np.array([(p > neg).mean() for p in pos])
    v01 = np.array([(pos > q).mean() for q in neg])
    theory = math.sqrt(v10.var(ddof=1) / len(pos) + v01.var(ddof=1) / len(neg))
    assert np.std(auc) == pytest.approx(theory, rel=.1)


def test_sketches_by_day(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.range(30_000).selectExpr("date_add(date'2024-01-01', int(id % 3)) AS d", "CASE WHEN id % 2 = 0 THEN 'x' END AS k", "id % 5000 AS u", "double(id) AS v")
    add_days(rows.filter("d < '2024-01-03'"), path, "d", ["k"], "u", "v")
    add_days(rows.filter("d = '2024-01-03'"), path, "d", ["k"], "u", "v")
    add_days(rows.filter("d = '2024-01-03'"), path, "d", ["k"], "u", "v")
    got = {r.k: r for r in distinct_between(spark, path, ["k"]).collect()}
    assert {k: r.n for k, r in got.items()} == {"x": 15_000, None: 15_000} and all(abs(r.distinct - 2500) < 125 for r in got.values())
    assert sum(r.n for r in distinct_between(spark, path, ["k"], "2024-01-02", "2024-01-02").collect()) == 10_000
    assert all(abs(r.value / 30_000 - r.p) < .02 for r in quantiles_between(spark, path, ["k"], [.1, .5, .9]).collect())


def test_models_of_a_fold_share_its_feature_stages(spark, monkeypatch):
    rows = spark.range(300).selectExpr("id", "double(id % 17) AS a", "double((id * 7) % 11) AS b", "CASE WHEN id % 2 = 0 THEN 'u' ELSE 'v' END AS g",
                                       "double(id % 17 + (id * 7) % 11 > 13) AS y", "int(id % 3) AS fold").cache()
    fits, plain = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df, *a: fits.append(1) or plain(self, df, *a))
    models = {"logreg": LogisticRegression(labelCol="y", maxIter=5), "tree": DecisionTreeClassifier(labelCol="y", maxDepth=3)}
    train, held = rows.filter("id < 240"), rows.filter("id >= 240")
    found = bakeoff("auc", models, train, held, BinaryClassificationEvaluator(labelCol="y"), ["a", "b"], ("g",), folds=3)
    assert len(fits) == 4  # three folds and the whole, for both models
    assert [f[1] for f in found] == ["logreg", "tree"]
    assert all(f[2] > .7 and f[3] >= 0 and f[4] > .7 and f[5] > 0 for f in found)


def test_bootstrap_of_a_mean_never_multiplies_rows(spark):
    from larkspur.operators.split import bootstrap_metric
    rng = np.random.default_rng(9)
    key = np.concatenate([rng.integers(0, 1 << 62, 20_000), np.arange(20_000), [-5, -1]])
    value = rng.integers(0, 2, len(key)).astype(float)
    null = np.arange(len(key)) % 11 == 0
    df = spark.createDataFrame([(int(k), None if g else float(v)) for k, v, g in zip(key, value, null)] + [(None, 1.0)], "id bigint, m double")
    b = bootstrap_metric(df, "id", F.col("m"), 30)
    got = {r.rep: r.value for r in b.collect()}
    w = poisson_weights(key, np.arange(30))
    want = (w * np.where(null, 0, value)[:, None]).sum(0) / w.sum(0)
    assert sorted(got) == list(range(30)) and all(got[i] == pytest.approx(want[i], rel=1e-12) for i in got)
    assert "sequence" not in b._jdf.queryExecution().optimizedPlan().toString()
    assert bootstrap_metric(df.filter("false"), "id", F.col("m"), 30).count() == 0
    assert all(r.value is None for r in bootstrap_metric(df.filter("m IS NULL AND id IS NOT NULL"), "id", F.col("m"), 3).collect())
    one = {r.rep: r.value for r in bootstrap_metric(df.filter("id = 7 AND m IS NOT NULL").withColumn("m", F.lit(1.0)), "id", F.col("m"), 30).collect()}
    assert {r for r, v in one.items() if v is None} == set(np.flatnonzero(poisson_weights(np.array([7]), np.arange(30))[0] == 0).tolist())


def test_regressors_on_sums_are_those_of_the_rows(spark):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
    from larkspur.plans.learning import bakeoff_on_sums
    v = spark.range(2000).selectExpr("id", "double(id % 17) + 500 AS a", "double((id * 7) % 11) / 10 AS b", "CASE id % 3 WHEN 0 THEN 'u' WHEN 1 THEN 'v' ELSE 'w' END AS g",
                                     "double(id % 17 * 3 + (id * 7) % 11 + (id % 3) * 5 + pmod(hash(id), 100) / 10) AS y", "int(pmod(hash(id, 1), 3)) AS fold", "id % 5 > 0 AS train").cache()
    models = {"linear": LinearRegression(labelCol="y"), "ridge": LinearRegression(labelCol="y", regParam=.7), "tree": DecisionTreeRegressor(labelCol="y", maxDepth=4)}
    want = bakeoff("rmse", models, v.filter("train"), v.filter("not train"), RegressionEvaluator(labelCol="y", metricName="rmse"), ["a", "b"], ("g",), folds=3)
    got = bakeoff_on_sums("rmse", models, v, ["a", "b"], "g", folds=3)
    for w, r in zip(want, got):
        assert r[:2] == w[:2] and r[5] > 0
        assert r[2:5] == pytest.approx(w[2:5], rel=1e-6)
