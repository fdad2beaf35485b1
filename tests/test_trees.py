"""Trees on cells of equal bins."""

import random

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from larkspur.models import trees as tr
from larkspur.plans import learning


def test_bins_hold_few_values_apart_and_many_in_equal_shares(spark):
    df = spark.range(4000).selectExpr("double(id % 7) AS few", "double(id) AS many", "double(1) AS one", "CASE WHEN id = 4 THEN NULL ELSE double(id % 2) END AS gap")
    edges = tr.bin_edges(df, ["few", "many", "one", "gap"])
    assert edges["few"] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0] and edges["one"] == [] and len(edges["many"]) == 31
    b = tr.binned(df, edges)
    sizes = [r["count"] for r in b.groupBy("many").count().collect()]
    assert len(sizes) == 32 and min(sizes) > 100 and max(sizes) < 150
    assert [r.few for r in b.select("few").distinct().orderBy("few").collect()] == list(range(7))
    assert b.filter("gap IS NULL").count() == 0 and b.filter("gap = 1").count() == 2001 and b.filter("one <> 0").count() == 0


def test_boosting_on_cells_is_that_of_the_rows(spark):
    rng = random.Random(2)
    rows = [(i, a, b, float(a * a - 3 * b + rng.randrange(9))) for i in range(3000) for a, b in [(rng.randrange(6), rng.randrange(4))]]
    df = spark.createDataFrame(rows, "id long, a int, b int, y double")
    c = tr.cells(df, ["a", "b"], "y", "id", 3)
    assert c.agg(F.sum("n")).first()[0] == 3000 and c.count() == 6 * 4 * 3
    whole, small = (VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(x) for x in (df, c))
    est = GBTRegressor(labelCol="y", maxIter=4, maxDepth=3, seed=1)
    at = whole.select("a", "b", "features").distinct()
    want, got = ({(r.a, r.b): r.prediction for r in m.transform(at).collect()} for m in (est.fit(whole), est.copy({est.weightCol: "n"}).fit(small)))
    assert len(want) == 24 and all(abs(want[k] - got[k]) < 1e-9 for k in want)


def test_regressor_is_fitted_on_cells(spark, t, monkeypatch):
    made = spark.range(20000).selectExpr("id", "double(id % 4) AS x1", "double(id % 3) AS x2", "double(id % 2) AS x3", "IF(id % 5 = 0, 'a', 'b') AS seg", "double(id % 4 + id % 3) AS y")
    monkeypatch.setattr(learning, "reg", lambda _: made)
    seen = []

    class Counted(GBTRegressor):
        def fit(self, dataset, params=None):
            seen.append((dataset.count(), dataset.agg(F.sum("n")).first()[0] if "n" in dataset.columns else None))
            return super().fit(dataset, params)

    monkeypatch.setattr(learning, "GBTRegressor", Counted)
    error = learning.gbt_regressor(t).first()[0]
    assert seen == [(seen[0][0], made.filter(learning.in_train()).count())] and seen[0][0] <= 24 * 16 and error < .2


def test_counted_cells_hold_every_row_and_boost_as_the_rows(spark):
    rng = random.Random(3)
    rows = [(a, b, float(rng.random() < (a + b) / 9)) for _ in range(2000) for a, b in [(min(rng.randrange(6), rng.randrange(6)), rng.randrange(4))]] + [(9, 9, 1.0)] * 500
    df = spark.createDataFrame(rows, "a int, b int, y double")
    c = tr.counted_cells(df, ["a", "b", "y"])
    counts = {(r.a, r.b, r.y): r["count"] for r in df.groupBy("a", "b", "y").count().collect()}
    got = {}
    for r in c.collect():
        got.setdefault((r.a, r.b, r.y), []).append(r.n)
    assert {k: sum(n) for k, n in got.items()} == counts
    assert all(len(n) == min(16, -(-counts[k] // 8)) and max(n) - min(n) <= 1 for k, n in got.items()) and len(got[9, 9, 1.0]) == 16
    whole, small = (VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(x) for x in (df, c))
    est = GBTClassifier(labelCol="y", maxIter=4, maxDepth=3, seed=1)
    at = whole.select("a", "b", "features").distinct()
    want, found = ({(r.a, r.b): r.rawPrediction[1] for r in m.transform(at).collect()} for m in (est.fit(whole), est.copy({est.weightCol: "n"}).fit(small)))
    assert len(want) == 25 and all(abs(want[k] - found[k]) < 1e-9 for k in want)


def test_sweeps_are_fitted_and_judged_on_cells_of_all_rows(spark, t, monkeypatch):
    made = spark.range(20000).selectExpr("id", "double(id % 4) AS score", "double(id % 3) AS amount", "int(id % 2) AS month", "double(1) AS noise",
                                         "IF(id % 5 = 0, 'a', 'b') AS grp", "double(id % 7 < id % 4 + id % 3) AS y")
    monkeypatch.setattr(learning, "cls", lambda _: made)
    seen, judged = [], []

    class Counted(GBTClassifier):
        def fit(self, dataset, params=None):
            seen.append((dataset.count(), dataset.agg(F.sum("n")).first()[0] if "n" in dataset.columns else None))
            return super().fit(dataset, params)

    area = learning.auc
    monkeypatch.setattr(learning, "GBTClassifier", Counted)
    monkeypatch.setattr(learning, "auc", lambda df, **kw: judged.append(df.agg(F.sum("n")).first()[0]) or area(df, **kw))
    got = learning.boosted_sweeps(t).collect()
    train = made.filter(learning.in_train()).count()
    assert seen == [(seen[0][0], train)] * 4 and seen[0][0] <= 4 * 3 * 2 * 2 * 16 and judged == [20000 - train] * 4
    assert [(r.step, r.subsample) for r in got] == [(.05, .5), (.05, 1.0), (.3, .5), (.3, 1.0)] and all(.6 < r.auc <= 1 for r in got)


def test_a_subsample_takes_rows_and_not_cells():
    import numpy as np
    from larkspur.models import boosting as bo
    bins, y = np.stack([np.arange(2000) % 40, np.arange(2000) // 40]), np.arange(2000) % 2
    n = np.full(2000, 400.0)
    kept = bo.drawn(bins, y, n, .5, 1, 3)
    # four hundred rows, each by itself: 200 and a deviation of 10, where cells of 16 parts deviate by 50
    assert abs(kept.mean() - 200) < 2 and 9 < kept.std() < 11 and kept.max() < 250
    assert (bo.drawn(bins[:, 700:], y[700:], n[700:], .5, 1, 3) == kept[700:]).all()
    assert not (bo.drawn(bins, y, n, .5, 1, 4) == kept).all() and (bo.drawn(bins, y, n, 1.0, 1, 3) == n).all()
    assert abs(bo.drawn(bins, y, np.ones(2000), .3, 1, 0).mean() - .3) < .05


def test_boost_on_cells_against_plain_newton_trees(spark):
    import numpy as np
    from larkspur.models import boosting as bo
    rng = random.Random(4)
    data = [(a, b, g, int(rng.random() < (a + b + 4 * (g == 1)) / 14)) for _ in range(3000) for a, b, g in [(rng.randrange(6), rng.randrange(4), rng.randrange(3))]]
    df = spark.createDataFrame(data, "a int, b int, g int, y int")
    c = df.groupBy("a", "b", "g", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    x, y = np.array(data)[:, :3], np.array(data)[:, 3]
    asks = [(0, lambda v, k: v > k), (1, lambda v, k: v > k), (2, lambda v, k: v == k)]

    def plain(s):
        score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
        worth = lambda g, h: max(abs(g) - s.l1, 0) ** 2 / (h + s.l2)
        for _ in range(s.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h, add = p - y, p * (1 - p), np.zeros(len(y))

            def grow(at, depth):
                add[at] = -np.sign(g[at].sum()) * max(abs(g[at].sum()) - s.l1, 0) / (h[at].sum() + s.l2)
                sides = [(j, ask(x[at, j], k)) for j, ask in asks for k in range(6)] if depth else []
                fair = [(round(worth(g[at][r].sum(), h[at][r].sum()) + worth(g[at][~r].sum(), h[at][~r].sum()) - worth(g[at].sum(), h[at].sum()), 7), r) for _, r in sides if min(h[at][r].sum(), h[at][~r].sum()) >= s.least]
                best = max(fair, key=lambda f: f[0], default=(0, None))
                if best[0] > 0:
                    grow(at[best[1]], depth - 1)
                    grow(at[~best[1]], depth - 1)

            grow(np.arange(len(y)), s.depth)
            score = score + s.step * add
        return score

    settings = [bo.Setting(.3, rounds=4), bo.Setting(.1, depth=2, l2=20.0, rounds=3), bo.Setting(.3, depth=4, l2=0.0, l1=15.0, rounds=2)]
    models = bo.boost(c.repartition(bo.FEW_TASKS + 1), ["a", "b", "g"], ["g"], settings)
    few = bo.boost(c.coalesce(2), ["a", "b", "g"], ["g"], settings)
    assert all(np.allclose(a.value, b.value) for m, o in zip(models, few) for a, b in zip(m.trees, o.trees))
    for s, m in zip(settings, models):
        got = {(r.a, r.b, r.g): r.rawPrediction for r in m.transform(c).collect()}
        want = plain(s)
        assert max(abs(got[tuple(k)] - w) for k, w in zip(x.tolist(), want)) < 1e-9
    found = bo.judged(c.withColumn("train", F.lit(True)), models, "train")
    for i, s in enumerate(settings):
        f = plain(s)
        want = ((f >= 0) == (y == 1)).mean(), -np.log(1 / (1 + np.exp(np.where(y == 1, -f, f)))).mean()
        assert np.allclose(found[i, True], want, atol=1e-9)


def test_sweeps_cover_depth_lambda_and_alpha(t):
    got = learning.boosted_sweeps(t).collect()
    last = got[-1]
    assert [r.by_depth is None for r in got] == [True, True, True, False]
    assert [e.depth for e in last.by_depth] == list(learning.DEPTHS)
    assert [e["lambda"] for e in last.by_lambda] == [e.alpha for e in last.by_alpha] == list(learning.PENALTIES)
    assert last.by_depth[-1].train_loss < last.by_depth[0].train_loss
    assert all(s[0].train_loss < s[-1].train_loss for s in (last.by_lambda, last.by_alpha)) and last.by_depth[1][1:] == last.by_lambda[2][1:]
    assert last.by_lambda[0][1:] == last.by_alpha[0][1:] and all(.5 < e.test <= 1 for s in (last.by_depth, last.by_lambda, last.by_alpha) for e in s)
