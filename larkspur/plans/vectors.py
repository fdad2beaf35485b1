"""Neighbours, components and clusters on vectors."""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from larkspur.functions.scalar import flag, let, rnd
from larkspur.metrics.tables import pair_agreement
from larkspur.models.decomposition import covariance, fit_pca
from larkspur.operators import cluster as cl
from larkspur.operators.clean import attach_one
from larkspur.operators.inverted import build_lists
from larkspur.operators.neighbors import knn, vote
from larkspur.plans.preparing import vectors
from larkspur.plans.registry import query, r6
from larkspur.plans.views import view

DIMS = 64


def labelled(t, k, **kw):
    """k nearest other vectors of every vector, with the neighbour's label."""
    v = vectors(t)
    hits = knn(v, v, k, "vec_id", "vec_id", rule="not_self", **kw)
    return hits.join(v.select(F.col("vec_id").alias("bid"), "label"), "bid")


def _nn(k, dist="list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", own=False):
    cond = "true" if own else "a.vec_id <> b.vec_id"
    return f"""n AS (SELECT * FROM (SELECT a.vec_id AS q, a.label AS truth, b.label, {dist} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {dist}, b.vec_id) AS rn FROM embeddings a JOIN embeddings b ON {cond}) WHERE rn <= {k})"""


def _vote(weight, name):
    return f"{name} AS (SELECT q, label AS pred FROM (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY sum({weight}) DESC, min(rn)) AS r FROM n GROUP BY 1, 2) WHERE r = 1)"


_L1 = "list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: abs(z[1] - z[2])))"
_WEIGHT = "CASE WHEN d = 0 THEN 1e10::DOUBLE ELSE 1 / d END"
def weight_col():
    return F.when(F.col("dist") == 0, 1e10).otherwise(1 / F.col("dist"))


@query("knn_classify", f"WITH {_nn(5)}, {_vote('1', 'u')}, {_vote(_WEIGHT, 'w')} SELECT u.q AS vec_id, u.pred AS uniform, w.pred AS weighted FROM u JOIN w ON u.q = w.q")
def knn_classify(t):
    h = labelled(t, 5)
    u, w = vote(h, "label").withColumnRenamed("pred", "uniform"), vote(h, "label", weight_col()).withColumnRenamed("pred", "weighted")
    return u.join(w, "qid").select(F.col("qid").alias("vec_id"), "uniform", "weighted")


@query("knn_manhattan", f"WITH {_nn(5, _L1)}, {_vote('1', 'u')} SELECT q AS vec_id, pred FROM u")
def knn_manhattan(t):
    return vote(labelled(t, 5, metric="l1"), "label").select(F.col("qid").alias("vec_id"), "pred")


@query("knn_regress", f"WITH {_nn(5)} SELECT q AS vec_id, {r6('avg(label)')} AS uniform, {r6(f'sum(label * {_WEIGHT}) / sum({_WEIGHT})')} AS weighted FROM n GROUP BY 1")
def knn_regress(t):
    h = labelled(t, 5)
    return h.groupBy(F.col("qid").alias("vec_id")).agg(rnd(F.avg("label")).alias("uniform"), rnd(F.sum(F.col("label") * weight_col()) / F.sum(weight_col())).alias("weighted"))


def approximate(t):
    """Every vector in an inverted list; the vectors whose id divides by 20 as queries, with their 10 neighbours found."""
    v = vectors(t)
    asked = v.filter("vec_id % 20 = 0")
    index = build_lists(v, "vec_id", recall=.97)
    return v, asked, index, index.search(asked, "vec_id", 10)


@query("knn_approx")
def knn_approx(t):
    _, _, _, found = approximate(t)
    return found.select("qid", "rank", "bid", rnd("dist").alias("dist"))


@query("knn_approx_recall", "SELECT count(*) AS queries, true AS recall_reached, true AS fewer_measured FROM embeddings WHERE vec_id % 20 = 0")
def knn_approx_recall(t):
    """Do the lists hold nine of ten true neighbours, and does a query measure fewer rows than there are?"""
    v, asked, index, found = approximate(t)
    true = knn(asked, v, 10, "vec_id", "vec_id", rule="not_self").select("qid", "bid")
    n = v.count()
    hit = true.join(found.select("qid", "bid").withColumn("hit", F.lit(1)), ["qid", "bid"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    cost = index.candidates(asked, "vec_id").agg(F.count(F.lit(1)).alias("queries"), F.avg("candidates").alias("measured"))
    return attach_one(cost, hit).select("queries", (F.col("recall") >= .9).alias("recall_reached"), (F.col("measured") < n).alias("fewer_measured"))


_COS = "(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


@query("cosine_knn_vote", f"WITH {_nn(50, _COS)}, v AS (SELECT q, label, sum(1 / (1 + d)) AS score FROM n GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, label) AS rn FROM v) SELECT q AS vec_id, label, CAST(rn AS INT) AS pos, {r6('score')} AS score FROM r WHERE rn <= 5")
def cosine_knn_vote(t):
    unit = unit_vector(F.col("vec"))
    v = vectors(t).withColumn("vec", unit)
    h = knn(v, v, 50, "vec_id", "vec_id", rule="not_self").join(v.select(F.col("vec_id").alias("bid"), "label"), "bid")
    cos_dist = F.col("dist") * F.col("dist") / 2
    s = h.groupBy("qid", "label").agg(F.sum(1 / (1 + cos_dist)).alias("score"))
    # at most one row per class and query: the ranking is a small array per query
    top = s.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("k"), "label", "score"))), 1, 5).alias("top"))
    return top.select(F.col("qid").alias("vec_id"), F.posexplode("top").alias("p", "c")).select("vec_id", "c.label", (F.col("p") + 1).alias("pos"), rnd("c.score").alias("score"))


def unit_vector(v):
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return let(norm, lambda n: F.transform(v, lambda x: F.try_divide(x, n)))


@query("k_sweep", f"WITH {_nn(10)}, k AS (SELECT unnest(range(1, 11)) AS k), c AS (SELECT q, truth, k, label, row_number() OVER (PARTITION BY q, k ORDER BY count(*) DESC, min(rn)) AS r FROM n JOIN k ON rn <= k GROUP BY 1, 2, 3, 4) SELECT CAST(k AS INT) AS k, {r6('avg(CAST(label <> truth AS INT))')} AS error FROM c WHERE r = 1 GROUP BY 1")
def k_sweep(t):
    """Leave-one-out error for every k from one top-10 pass."""
    h = labelled(t, 10).withColumn("k", F.explode(F.sequence("rn", F.lit(10))))
    per = h.groupBy("qid", "k", "label").agg(F.count(F.lit(1)).alias("v"), F.min("rn").alias("first"))
    pred = per.groupBy("qid", "k").agg(F.max_by("label", F.struct("v", -F.col("first"))).alias("pred"))
    truth = vectors(t).select(F.col("vec_id").alias("qid"), "label")
    return pred.join(truth, "qid").groupBy("k").agg(rnd(F.avg(flag(F.col("pred") != F.col("label")))).alias("error"))


@query("k_distance", f"WITH {_nn(5, own=True)} SELECT q AS vec_id, {r6('max(d)')} AS distance FROM n GROUP BY 1")
def k_distance(t):
    v = vectors(t)
    h = knn(v, v, 5, "vec_id", "vec_id").filter("rn = 5")
    return h.select(F.col("qid").alias("vec_id"), rnd("dist").alias("distance"))


@query("vector_concat_norm", f"WITH c AS (SELECT vec_id, list_concat(embedding::DOUBLE[], list_transform(embedding::DOUBLE[], lambda x: x * x)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM c) SELECT vec_id, CAST(len(v) AS INT) AS dims, {r6('v[1] / n')} AS first, {r6('v[128] / n')} AS last FROM n")
def vector_concat_norm(t):
    v = vectors(t).select("vec_id", unit_vector(F.concat("vec", F.transform("vec", lambda x: x * x))).alias("v"))
    return v.select("vec_id", F.size("v").alias("dims"), rnd(F.col("v")[0]).alias("first"), rnd(F.element_at("v", -1)).alias("last"))


@query("covariance_matrix", f"WITH e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, 64)) AS i FROM embeddings) SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, {r6('covar_samp(a.x, b.x)')} AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY 1, 2")
def covariance_matrix(t):
    return covariance(vectors(t), DIMS)[0].select("i", "j", rnd("cov").alias("cov"))


@query("pca_fit")
def pca_fit(t):
    p = fit_pca(vectors(t), DIMS)
    rows = [(i, float(v), float(r)) for i, (v, r) in enumerate(zip(p.variance, p.ratio))]
    return t.spark.createDataFrame(rows, "component int, variance double, ratio double")


@query("pca_transform")
def pca_transform(t):
    v = vectors(t)
    return fit_pca(v, DIMS).transform(v, 8).select("vec_id", "pc")


@query("pca_recon_error")
def pca_recon_error(t):
    v = vectors(t)
    p = fit_pca(v, DIMS)
    back = p.inverse(p.transform(v, 16), 16)
    sq = F.aggregate(F.zip_with("vec", "rebuilt", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / DIMS
    return back.agg(rnd(F.avg(sq)).alias("mse"))


@query("pca_inverse")
def pca_inverse(t):
    v = vectors(t)
    p = fit_pca(v, DIMS)
    return p.inverse(p.transform(v, DIMS), DIMS).select("vec_id", "rebuilt")


@query("pca_n_for_variance")
def pca_n_for_variance(t):
    p = fit_pca(vectors(t), DIMS)
    return t.spark.createDataFrame([(s, p.n_for(s)) for s in (.8, .9, .95, .99)], "share double, n_components int")


@query("pca_loadings")
def pca_loadings(t):
    p = fit_pca(vectors(t), DIMS)
    rows = [(c, int(j), float(p.components[c, j])) for c in range(4) for j in np.abs(p.components[c]).argsort()[::-1][:5]]
    return t.spark.createDataFrame(rows, "component int, dim int, loading double")


# ---- clustering ----------------------------------------------------------------------------------

def features(t):
    return vectors(t).withColumn("features", array_to_vector("vec")).cache()


@query("kmeans")
def kmeans(t):
    """Best of several seeded starts by training cost."""
    v = features(t)
    fits = [KMeans(k=10, seed=s, maxIter=20, tol=1e-4).fit(v) for s in (1, 2, 3)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(v).groupBy("prediction").agg(F.count(F.lit(1)).alias("n")).withColumn("inertia", F.lit(float(best.summary.trainingCost)))


_CENTRES = "c AS (SELECT label AS k, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, 64)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"


@query("kmeans_step", f"""WITH {_CENTRES}, a AS (SELECT vec_id, arg_min(k, list_distance(embedding::DOUBLE[], c)) AS cluster FROM embeddings, c GROUP BY 1), x AS (SELECT cluster, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, 64)) AS i FROM embeddings JOIN a USING (vec_id))
    SELECT CAST(cluster AS INT) AS cluster, CAST(i AS INT) AS dim, {r6('avg(x)')} AS centre, count(*) AS n FROM x GROUP BY 1, 2""")
def kmeans_step(t):
    v = vectors(t)
    start = {r.label: r["mean"] for r in cl.centre_means(v, "label", DIMS).collect()}
    centres = np.array([start[k] for k in sorted(start)])
    s = cl.kmeans_step(v, centres)
    return s.select("cluster", "n", F.posexplode("mean").alias("dim", "c")).select("cluster", "dim", rnd("c").alias("centre"), "n")


@query("elbow")
def elbow(t):
    v = features(t)
    rows = []
    for k in (2, 4, 6, 8, 10, 12):
        m = KMeans(k=k, seed=1, maxIter=20).fit(v)
        rows.append((k, float(m.summary.trainingCost), float(ClusteringEvaluator().evaluate(m.transform(v)))))
    return t.spark.createDataFrame(rows, "k int, inertia double, silhouette double")


_SIL = """d AS (SELECT a.vec_id AS q, a.label AS own, b.label AS other, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ^ 2) AS s, count(*) AS n FROM embeddings a JOIN embeddings b ON true GROUP BY 1, 2, 3),
    m AS (SELECT q, max(CASE WHEN own = other THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY 1)"""


@query("silhouette", f"WITH {_SIL} SELECT {r6('avg((b - a) / greatest(a, b))', 5)} AS silhouette FROM m")
def silhouette(t):
    """Squared-distance silhouette of the given labels over all rows, from per-cluster sums."""
    v = features(t).withColumn("prediction", F.col("label").cast("double"))
    value = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(v)
    return t.spark.range(1).select(rnd(F.lit(float(value)), 5).alias("silhouette"))


@query("minibatch_kmeans")
def minibatch_kmeans(t):
    v = vectors(t)
    start = np.array([r.vec for r in v.orderBy(F.xxhash64("vec_id")).limit(10).collect()])
    c = cl.minibatch_kmeans(v, "vec_id", start, 8)
    return cl.assign_nearest(v, c).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("inertia"))


def places(t):
    return view(t, "v_place").select("id", "value", F.array("lat", "lon").alias("vec"))


def density_sql(settings: str, tail: str) -> str:
    """Clusters by a recursive walk over core points; ``settings`` lists (eps, least)."""
    return f"""
WITH RECURSIVE settings(eps, least) AS (VALUES {settings}),
near AS (
  SELECT eps, least, p.id AS a, q.id AS b FROM settings, v_place p, v_place q
  WHERE sqrt((p.lat - q.lat) * (p.lat - q.lat) + (p.lon - q.lon) * (p.lon - q.lon)) <= eps),
core AS (SELECT eps, least, a AS id FROM near GROUP BY ALL HAVING count(*) >= least),
link AS (
  SELECT n.* FROM near n JOIN core x ON x.id = n.a AND x.eps = n.eps AND x.least = n.least
  JOIN core y ON y.id = n.b AND y.eps = n.eps AND y.least = n.least),
walk AS (
  SELECT eps, least, id, id AS root FROM core
  UNION
  SELECT w.eps, w.least, l.b, w.root FROM walk w JOIN link l ON l.a = w.id AND l.eps = w.eps AND l.least = w.least),
inner_ AS (SELECT eps, least, id, min(root) AS cluster FROM walk GROUP BY ALL),
outer_ AS (
  SELECT n.eps, n.least, n.a AS id, min(i.cluster) AS cluster FROM near n
  JOIN inner_ i ON i.id = n.b AND i.eps = n.eps AND i.least = n.least GROUP BY ALL),
found AS (
  SELECT s.eps, s.least, p.id, p.value, coalesce(i.cluster, o.cluster, -1)::BIGINT AS cluster, i.id IS NOT NULL AS is_core
  FROM settings s CROSS JOIN v_place p LEFT JOIN inner_ i ON i.id = p.id AND i.eps = s.eps AND i.least = s.least
  LEFT JOIN outer_ o ON o.id = p.id AND o.eps = s.eps AND o.least = s.least)
{tail}"""


@query("dbscan", density_sql("(0.08::DOUBLE, 5)", "SELECT id, cluster, is_core FROM found"))
def dbscan(t):
    return cl.dbscan(places(t), "id", "vec", 0.08, 5, 2)


SWEEP = [(0.06, 5), (0.08, 5), (0.1, 5), (0.08, 3), (0.08, 10)]


@query("dbscan_noise_profile", density_sql(", ".join(f"({e}::DOUBLE, {m})" for e, m in SWEEP), f"""
SELECT eps, least, cluster = -1 AS noise, count(*)::BIGINT AS n, {r6("avg(value)")} AS mean_value, count(DISTINCT cluster)::BIGINT AS clusters
FROM found GROUP BY ALL"""))
def dbscan_noise_profile(t):
    """Noise against clustered rows, for radii and for least neighbours."""
    p = places(t)

    def profile(setting):
        eps, least = setting
        c = cl.dbscan(p, "id", "vec", eps, least, 2).join(p.select("id", "value"), "id")
        g = c.groupBy((F.col("cluster") == -1).alias("noise")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("value")).alias("mean_value"), F.countDistinct("cluster").alias("clusters"))
        return g.withColumns({"eps": F.lit(eps), "least": F.lit(least)})

    # the settings are independent and each is many short jobs: their jobs share the cluster
    with ThreadPoolExecutor(len(SWEEP)) as threads:
        return reduce(DataFrame.unionByName, threads.map(profile, SWEEP))


@query("cluster_feature")
def cluster_feature(t):
    v = features(t)
    m = KMeans(k=10, seed=1, maxIter=20).fit(v)
    return m.transform(v).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg((F.col("label") == 0).cast("int"))).alias("rate"))


@query("cluster_agreement")
def cluster_agreement(t):
    """Found clusters against the given labels."""
    v = features(t)
    m = KMeans(k=10, seed=1, maxIter=20).fit(v)
    return pair_agreement(m.transform(v), "prediction", "label")
