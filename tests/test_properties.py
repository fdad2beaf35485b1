"""Properties of operators that have no fair SQL twin, on small planted inputs."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.metrics.survival import concordance
from larkspur.models import linear as ln
from larkspur.models.decomposition import fit_pca
from larkspur.operators import cluster as cl, neighbors
from larkspur.operators.clean import impute, quantile_bins
from larkspur.operators.encode import target_encode_oof
from larkspur.operators.prefix import exact_quantiles, global_cumsum, numbered
from larkspur.operators.windows import over_rows, running


def test_quantiles_with_ties_nulls_and_hot_value(spark):
    rng = np.random.default_rng(0)
    x = [float(v) for v in np.round(rng.normal(size=300), 1)] + [5.0] * 150 + [None] * 10
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(x)], "g int, x double")
    got = {r.g: r for r in exact_quantiles(df, "x", {"a": 0.1, "b": 0.5, "c": 1.0}, ["g"]).collect()}
    for g in range(3):
        own = [v for i, v in enumerate(x) if i % 3 == g and v is not None]
        assert np.allclose([got[g].a, got[g].b, got[g].c], np.quantile(own, [0.1, 0.5, 1.0]))


def test_cumsum_is_the_same_at_any_slicing(spark):
    df = spark.createDataFrame([(i % 7, float(i % 50), i) for i in range(1000)], "k int, x double, v int")
    a = global_cumsum(df, "x", {"v": F.col("v")}, ["k"], slices=2).orderBy("k", "x").collect()
    b = global_cumsum(df.repartition(5), "x", {"v": F.col("v")}, ["k"], slices=17).orderBy("k", "x").collect()
    assert a == b


def test_numbered_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(i, float(i % 9)) for i in range(500)], "id int, x double")
    r = numbered(df, "x", "id").orderBy("rn").collect()
    assert [x.rn for x in r] == list(range(1, 501))
    assert [(x.x, x.id) for x in r] == sorted((x.x, x.id) for x in r)


def test_single_rows_and_constant_column(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "g string, x double")
    assert impute(df, {"x": "median"}, by=["g"]).filter("x is null").count() == 0
    same = spark.createDataFrame([(i, 3.0) for i in range(5)], "id int, x double")
    assert quantile_bins(same, "x", 4, "b").select("b").distinct().count() == 1


def test_no_feature_looks_ahead(spark, t):
    e = t.events.withColumn("clock", F.unix_micros(F.col("ts").cast("timestamp")))
    cut = e.agg(F.percentile_approx("clock", 0.6)).first()[0]

    def feats(df):
        df = over_rows(df, ["user_id"], "clock", "event_id", lambda w: {"m": F.avg("value").over(w.rowsBetween(-7, -1))}, before=7)
        return running(df, ["user_id"], "clock", "event_id", {"s": ("sum", F.col("value"))}, include_current=False).select("event_id", "clock", "m", "s")

    past = e.filter(F.col("clock") <= cut)
    whole = feats(e).filter(F.col("clock") <= cut)
    assert whole.exceptAll(feats(past)).count() == 0


def test_oof_encoding_never_sees_its_own_fold(spark):
    rows = [(i, "ab"[i % 2], i % 5, float(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, c string, fold int, y double")
    flipped = df.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y")))
    enc = lambda d: target_encode_oof(d, "c", "y", "fold", "e").filter("fold = 0").select("id", F.round("e", 12).alias("e"))
    assert enc(df).exceptAll(enc(flipped)).count() == 0


def test_descent_reaches_the_normal_equation(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 1.5 + x @ [2.0, -1.0]
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    history = []
    w = ln.gradient_descent(df, ["a", "b"], "y", rate=0.3, steps=25, history=history)
    assert np.allclose(w, ln.normal_equation(df, ["a", "b"], "y"), atol=1e-3)
    assert all(p >= n - 1e-12 for p, n in zip(history, history[1:]))


def test_quantile_fit_leaves_the_wanted_share_below(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(size=600)
    y = 2 * x + rng.normal(size=600)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    for q, w in zip((0.2, 0.9), ln.quantile_fit(df, ["x"], "y", (0.2, 0.9))):
        assert abs(float((y <= w[0] + w[1] * x).mean()) - q) < 0.02


def test_cox_recovers_a_planted_effect(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, 800).astype(float)
    t = np.ceil(rng.exponential(1 / np.exp(0.8 * x)) * 20)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, t, rng.uniform(size=800) < 0.8)], "x double, t double, e int")
    assert abs(ln.cox_fit(df, ["x"], "t", "e", l2=0.0)[0] - 0.8) < 0.25


def test_concordance_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(d), int(e), float(r)) for d, e, r in zip(rng.integers(1, 40, 200), rng.integers(0, 2, 200), rng.integers(0, 15, 200))]
    got = concordance(spark.createDataFrame(rows, "d int, e int, r double"), "d", "e", "r").first()
    pairs = [(a, b) for a in rows for b in rows if a[1] and a[0] < b[0]]
    assert (got.comparable, got.concordant, got.tied) == (len(pairs), sum(a[2] > b[2] for a, b in pairs), sum(a[2] == b[2] for a, b in pairs))


def test_pca_inverse_restores_the_input(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(100, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, vec array<double>")
    p = fit_pca(df, 4)
    back = p.inverse(p.transform(df, 4), 4).orderBy("id").collect()
    assert np.allclose([r.rebuilt for r in back], x)
    assert np.allclose(p.variance, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])


def brute_dbscan(x, eps, m):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = d.sum(1) >= m
    lab = -np.ones(len(x), int)
    for s in range(len(x)):
        if core[s] and lab[s] < 0:
            todo, lab[s] = [s], s
            while todo:
                for j in np.flatnonzero(d[todo.pop()] & core):
                    if lab[j] < 0:
                        lab[j] = s
                        todo.append(j)
    for i in np.flatnonzero(~core):
        near = lab[d[i] & core]
        if len(near):
            lab[i] = near.min()
    return lab, core


@pytest.mark.parametrize("block", ["64", "20000"])
def test_dbscan_matches_brute_force(spark, block):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, .3, (60, 2)), rng.normal(2, .2, (60, 2)), np.zeros((30, 2)), rng.uniform(-2, 4, (40, 2))])
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id bigint, vec array<double>")
    got = {r.id: r for r in cl.dbscan(df, "id", "vec", 0.25, 5, 2, block_rows=int(block)).collect()}
    lab, core = brute_dbscan(x, 0.25, 5)
    assert [got[i].is_core for i in range(len(x))] == list(core)
    assert [got[i].cluster for i in range(len(x))] == list(lab)


def test_components(spark):
    """Scattered edges with loops and null ends; a path of 100,000 edges, in order and shuffled."""
    import time
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 6), (7, 5), (8, 8), (None, 4)], "a bigint, b bigint")
    assert sorted(map(tuple, cl.components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 5), (8, 8), (9, 1)]
    assert cl.components(edges.filter("false")).count() == 0
    t0 = time.time()
    for name in ("id", "id * 48271 % 2147483647"):
        path = spark.range(100_000).selectExpr(f"{name} AS a", name.replace("id", "(id + 1)") + " AS b")
        got = cl.components(path).agg(F.countDistinct("root"), F.min("root"), F.count("node")).first()
        assert tuple(got) == (1, 0, 100_001)
    assert time.time() - t0 < 120


def test_dbscan_of_crowded_cells_measures_few_distances(spark):
    """Two crowded neighbours and a far one: 300,000 points settle by cells; squares of distances would not end."""
    rows = spark.range(300_000).selectExpr("id", "array(0.001 * (id % 997) / 10 + CASE WHEN id % 3 = 0 THEN 0.12 WHEN id % 3 = 1 THEN 0.0 ELSE 5.0 END, 0.0001 * (id % 991)) AS vec")
    got = cl.dbscan(rows, "id", "vec", 0.15, 10, 2, block_rows=5000).groupBy("cluster", "is_core").count().collect()
    assert sorted((r.cluster, r.is_core, r["count"]) for r in got) == [(0, True, 200_000), (2, True, 100_000)]


def test_dbscan_in_five_axes_nulls_and_empty(spark):
    rng = np.random.default_rng(8)
    for dims in (5,):
        x = np.concatenate([rng.normal(0, .3, (50, dims)), rng.normal(2, .3, (50, dims)), rng.uniform(-2, 4, (20, dims))])
        rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(500, None)]
        df = spark.createDataFrame(rows, "id bigint, vec array<double>")
        got = {r.id: r for r in cl.dbscan(df, "id", "vec", 0.7, 4, dims, block_rows=16).collect()}
        lab, core = brute_dbscan(x, 0.7, 4)
        assert [got[i].is_core for i in range(len(x))] == list(core) and [got[i].cluster for i in range(len(x))] == list(lab)
        assert (got[500].cluster, got[500].is_core) == (-1, False)
    assert cl.dbscan(df.filter("false"), "id", "vec", 0.7, 4, 5).count() == 0


def test_mix_hash_has_no_short_period(spark):
    from larkspur.functions.scalar import mix_hash
    keys = spark.range(0, 400_000).selectExpr("id * 1000003 + 5 AS k")
    h = keys.select(mix_hash("k", 1).alias("a"), mix_hash("k", 2).alias("b")).toPandas()
    assert h.a.nunique() > 399_900 and h.drop_duplicates().shape[0] == 400_000
    assert abs(h.a.mean() - 0.5) < 0.003 and abs(h.a.corr(h.b)) < 0.01 and abs(h.a.std() - 12 ** -0.5) < 0.002


def test_out_of_fold_codes_keep_rows_with_null_categories(spark):
    from larkspur.operators.encode import target_encode_oof
    df = spark.createDataFrame([(1, None, 0, 1.0), (2, "a", 0, 0.0), (3, None, 1, 3.0), (4, "b", 1, None), (5, "a", None, 1.0)], "id int, c string, f int, y double")
    got = {r.id: r.e for r in target_encode_oof(df, "c", "y", "f", "e").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[1] > got[2]


def test_streams_take_events_of_any_year(spark):
    import types
    from larkspur.plans.flows import parts
    rows = [(i, f"{y}-03-0{i % 9 + 1} 10:00:00", i % 3, "click", 1.0) for i, y in enumerate([2019, 2024, 2025, 2025, 2031] * 4)]
    e = spark.createDataFrame(rows, "event_id bigint, ts string, user_id int, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value")
    assert sum(p.count() for p in parts(types.SimpleNamespace(events=e))) == len(rows)


def test_manhattan_distances_stay_in_tiles():
    rng = np.random.default_rng(8)
    q, b = rng.normal(size=(201, 5)), rng.normal(size=(2500, 5))
    tracemalloc.start()
    got = neighbors._distances(q, b, "l1")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = sum(np.abs(q[:, [j]] - b[:, j]) for j in range(5))
    assert (got == want).all()
    # the result and a few tiles; whole matrices of differences took three times the result
    assert peak < 2 * got.nbytes
