"""Estimators: closed forms, pyspark.ml models and compositions of them."""

import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier, FMClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PolynomialExpansion, StringIndexer, UnivariateFeatureSelector, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import (
    AFTSurvivalRegression, DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression,
    RandomForestRegressor)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.functions.scalar import flag, mix_hash, poisson1, ratio, rnd
from larkspur.metrics import ranking as rk, survival as sv, tables as mt
from larkspur.models import bayes as nb, boosting as bo, linear as ln, trees as tr
from larkspur.models.fitting import assembled, feature_stages, out_of_fold, p1, rows, with_fold
from larkspur.models.isotonic import isotonic_apply, isotonic_blocks
from larkspur.operators import encode as en
from larkspur.operators.clean import attach_one
from larkspur.operators.prefix import exact_quantiles, global_cumsum
from larkspur.operators.split import kfold
from larkspur.plans.registry import mix, query, r6
from larkspur.plans.series import events
from larkspur.plans.texts import _STOP, _TERMS
from larkspur.plans.views import view
from larkspur.session import cut, release

NUM = ["score", "amount", "month", "noise"]

#: Most rows of one part of a table that models are fitted on
PART_ROWS = 500_000


def cls(t):
    """Classification rows: id, label y, numeric and categorical features, treatment arm."""
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.month("o_orderdate").alias("month"), F.col("o_orderstatus").alias("status"))
    s = view(t, "v_scores").select("id", "score", (F.col("amount") / 1e5).alias("amount"), "grp", "treatment", F.col("y").cast("double").alias("y"))
    return s.join(o, "id").withColumn("noise", mix_hash("id", 21))


def spread(df, n, key="id"):
    """Rows dealt by key over every core, as many parts on each, more where there are more of ``n`` rows: a fit works long on few bytes, so splits by size leave cores idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * max(1, -(-n // (PART_ROWS * cores))), *([key] if isinstance(key, str) else key))


def cls_vec(t, cats=("grp",), **more):
    """Feature vectors of :func:`cls`, with further columns made from its own."""
    return spread(assembled(cls(t).withColumns(more), NUM, cats, train=in_train()), t.orders.count()).cache()


def reg(t):
    """Regression rows: price of a line from quantity, list price, discount and segment (all in thousands)."""
    r = view(t, "v_reg")
    key = F.xxhash64("l_orderkey", "l_linenumber", "y")
    return r.select(key.alias("id"), "x1", (F.col("x2") / 1e3).alias("x2"), "x3", "seg", (F.col("y") / 1e3).alias("y"), (F.col("y_hat") / 1e3).alias("y_hat"))


def reg_vec(t):
    return spread(assembled(reg(t), ["x1", "x2", "x3"], ["seg"], train=in_train()), t.lineitem.count()).cache()


def in_train(key="id"):
    """The rows that models, scalers and indexers may learn from."""
    return mix_hash(F.pmod(F.col(key), F.lit(1 << 40)), 31) < .8


def halves(df, key="id"):
    return df.filter(in_train(key)), df.filter(~in_train(key))


def auc(df, raw="rawPrediction", weight=None):
    return rk.AreaUnderRoc("y", raw, weight).evaluate(df)


def rmse(df, p="prediction"):
    return float(RegressionEvaluator(labelCol="y", predictionCol=p).evaluate(df))


# ---- linear --------------------------------------------------------------------------------------

@query("linreg_gd")
def linreg_gd(t):
    """Gradient descent on standardised columns, next to the normal equation it must reach."""
    r = en.standard_scale(reg(t).select("x1", "x2", "y"), ["x1", "x2"], F.lit(True))
    history = []
    w = ln.gradient_descent(r, ["x1", "x2"], "y", rate=0.4, steps=25, history=history)
    exact = ln.normal_equation(r, ["x1", "x2"], "y")
    return rows(t.spark, [(n, float(a), float(b)) for n, a, b in zip(("bias", "x1", "x2"), w, exact)], "term string, descent double, exact double")


@query("linreg_normal", f"""WITH m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, covar_pop(x1, x1) AS s11, covar_pop(x1, x2) AS s12, covar_pop(x2, x2) AS s22, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM v_reg),
    b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m)
    SELECT 'bias' AS term, {r6('my - b1 * m1 - b2 * m2', 3)} AS weight FROM b UNION ALL SELECT 'x1', {r6('b1', 3)} FROM b UNION ALL SELECT 'x2', {r6('b2', 3)} FROM b""")
def linreg_normal(t):
    w = ln.normal_equation(view(t, "v_reg"), ["x1", "x2"], "y")
    return rows(t.spark, list(zip(("bias", "x1", "x2"), map(float, w))), "term string, w double").select("term", rnd("w", 3).alias("weight"))


def _penalised(t, alpha, lam):
    train, test = halves(reg_vec(t))
    m = LinearRegression(labelCol="y", regParam=lam, elasticNetParam=alpha, maxIter=50).fit(train)
    return rows(t.spark, [(float(lam), float(alpha), rmse(m.transform(test)), int((np.abs(m.coefficients.toArray()) > 1e-9).sum()))], "lambda double, alpha double, rmse double, nonzero int")


@query("ridge")
def ridge(t):
    return _penalised(t, 0.0, 0.1)


@query("lasso")
def lasso(t):
    return _penalised(t, 1.0, 0.1)


@query("elastic_net")
def elastic_net(t):
    return _penalised(t, 0.5, 0.1)


@query("huber_reg")
def huber_reg(t):
    train, test = halves(reg_vec(t))
    m = LinearRegression(labelCol="y", loss="huber", maxIter=50).fit(train)
    return rows(t.spark, [(rmse(m.transform(test)), float(m.scale))], "rmse double, scale double")


@query("poly_regression")
def poly_regression(t):
    v = assembled(reg(t), ["x1", "x2"], train=in_train()).withColumnRenamed("features", "base").cache()
    train, test = halves(v)
    out = []
    for d in (1, 2, 3):
        e = PolynomialExpansion(degree=d, inputCol="base", outputCol="features")
        m = LinearRegression(labelCol="y", regParam=1e-6).fit(e.transform(train))
        out.append((d, rmse(m.transform(e.transform(train))), rmse(m.transform(e.transform(test)))))
    return rows(t.spark, out, "degree int, train_rmse double, test_rmse double")


@query("logreg_binary")
def logreg_binary(t):
    train, test = halves(cls_vec(t))
    m = LogisticRegression(labelCol="y", maxIter=30).fit(train)
    return m.transform(test).select("id", "y", rnd(p1()).alias("p"), flag(p1() >= 0.5).alias("pred"))


@query("logreg_gd")
def logreg_gd(t):
    r = en.standard_scale(cls(t).select("score", "amount", "y"), ["score", "amount"], F.lit(True))
    history = []
    w = ln.gradient_descent(r, ["score", "amount"], "y", rate=2.0, steps=20, link="logit", history=history)
    return rows(t.spark, [(i, float(v)) for i, v in enumerate(history)], "step int, loss double").withColumn("final_weight", F.lit(float(w[1])))


@query("logreg_multi")
def logreg_multi(t):
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("y"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).cache()
    train, test = halves(v)
    m = LogisticRegression(labelCol="y", family="multinomial", maxIter=30, regParam=0.01).fit(train)
    return m.transform(test).select("id", F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"))


@query("linear_svm")
def linear_svm(t):
    train, test = halves(cls_vec(t))
    p = LinearSVC(labelCol="y", maxIter=20, regParam=0.01).fit(train).transform(test)
    return p.groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n"))


def fourier(df, cols, gamma, d=32, seed=3):
    """Random Fourier features of the RBF kernel exp(-gamma |x - x'|^2)."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (d, len(cols))), rng.uniform(0, 2 * np.pi, d)
    z = [float(np.sqrt(2 / d)) * F.cos(ln.dot(cols, w[i], b[i])) for i in range(d)]
    return df.withColumn("features", array_to_vector(F.array(*z)))


@query("kernel_svm_rff")
def kernel_svm_rff(t):
    # a fit is some 70 passes, and each task of a pass reports to the driver: few parts of many rows
    base = spread(en.standard_scale(cls(t), NUM, in_train()).select("id", "y", *NUM), t.orders.count()).cache()
    n, out = base.filter(in_train()).count(), []
    for gamma, c in ((0.1, 1.0), (0.5, 1.0), (0.5, 10.0)):
        train, test = halves(fourier(base, NUM, gamma).cache())
        m = LinearSVC(labelCol="y", maxIter=15, regParam=1 / (c * n), standardization=False).fit(train)
        out.append((gamma, c, auc(m.transform(test))))
    return rows(t.spark, out, "gamma double, c double, auc double")


# ---- Bayes ---------------------------------------------------------------------------------------

_GNB = """f AS (SELECT id, score, amount / 1e5 AS amount, y FROM v_scores), m AS (SELECT y AS cls, count(*) AS n, avg(score) AS ms, var_pop(score) + 1e-9 AS vs, avg(amount) AS ma, var_pop(amount) + 1e-9 AS va FROM f WHERE id % 5 <> 0 GROUP BY 1),
    p AS (SELECT id, cls, ln(n / (SELECT sum(n) FROM m)) - .5 * ln(2 * pi() * vs) - (score - ms) ^ 2 / (2 * vs) - .5 * ln(2 * pi() * va) - (amount - ma) ^ 2 / (2 * va) AS lp FROM f, m)"""


@query("gaussian_nb", f"WITH {_GNB} SELECT id, CAST(arg_max(cls, lp) AS INT) AS pred, {r6('1 / (1 + exp(min(lp) - max(lp)))')} AS prob FROM p GROUP BY 1")
def gaussian_nb(t):
    f = view(t, "v_scores").select("id", "score", (F.col("amount") / 1e5).alias("amount"), "y")
    m = nb.gaussian_fit(f.filter("id % 5 <> 0"), ["score", "amount"], "y")
    return nb.gaussian_score(f, m, ["score", "amount"]).select("id", F.col("pred").cast("int").alias("pred"), rnd("prob").alias("prob"))


def nb_input(t):
    """Labelled documents with their distinct terms and occurrences, tokenised once, the train rows among them, and the class counts of every term that three train documents hold."""
    docs = cut(tx.with_terms(view(t, "v_text"), "text").select("doc_id", "y", tx.run_counts(F.col("terms")).alias("runs")))
    train = docs.filter("doc_id % 5 <> 0")
    return docs, train, cut(nb.class_term_table(train, "y", 3))


_TT = _TERMS.replace("FROM documents), g", "FROM v_text), g")
_NB = f"""{_TT}, tr AS (SELECT * FROM c WHERE doc_id % 5 <> 0), voc AS (SELECT term FROM tr GROUP BY 1 HAVING count(*) >= 3), c5 AS (SELECT c.* FROM c JOIN voc USING (term)), lab AS (SELECT doc_id, y FROM v_text),
    lt AS (SELECT * FROM lab WHERE doc_id % 5 <> 0), cl AS (SELECT y AS cls, count(*) AS nd2 FROM lt GROUP BY 1),
    ct AS (SELECT y AS cls, term, sum(tf) AS n, count(*) AS docs FROM c5 JOIN lt USING (doc_id) GROUP BY 1, 2), fu AS (SELECT cl.cls, voc.term, coalesce(n, 0) AS n, coalesce(docs, 0) AS docs, nd2 FROM cl CROSS JOIN voc LEFT JOIN ct ON ct.cls = cl.cls AND ct.term = voc.term)"""
_NBOUT = "SELECT doc_id, CAST(arg_max(cls, round(score, 6) + cls * 1e-9) AS INT) AS pred, {s} AS score FROM s GROUP BY 1"


def _nb_sql(w, bias, tf="tf"):
    return f"""WITH {_NB}, w AS ({w}), b AS ({bias}), d AS (SELECT doc_id, w.cls, sum({tf} * w.w) AS s FROM c5 JOIN w USING (term) GROUP BY 1, 2), s AS (SELECT lab.doc_id, b.cls, bias + coalesce(s, 0) AS score FROM lab CROSS JOIN b LEFT JOIN d ON d.doc_id = lab.doc_id AND d.cls = b.cls)
    {_NBOUT.format(s=r6('max(score)', 4))}"""


_PRIOR = "SELECT cls, ln(nd2 / (SELECT sum(nd2) FROM cl)) AS bias FROM cl"


def _nb_query(t, fit, binary=False):
    docs, train, table = nb_input(t)
    s, = nb.term_scores(docs, "doc_id", table, [fit(table, train, "y")], binary)
    return nb.best_class(s, "doc_id").select("doc_id", F.col("pred").cast("int").alias("pred"), rnd("score", 4).alias("score"))


@query("multinomial_nb", _nb_sql("SELECT cls, term, ln((n + 1) / (sum(n) OVER (PARTITION BY cls) + count(*) OVER (PARTITION BY cls))) AS w FROM fu", _PRIOR))
def multinomial_nb(t):
    return _nb_query(t, nb.multinomial_fit)


@query("complement_nb", _nb_sql("SELECT cls, term, -ln(c / sum(c) OVER (PARTITION BY cls)) AS w FROM (SELECT cls, term, sum(n) OVER (PARTITION BY term) - n + 1 AS c FROM fu)", "SELECT cls, 0.0::DOUBLE AS bias FROM cl"))
def complement_nb(t):
    return _nb_query(t, nb.complement_fit)


@query("bernoulli_nb", _nb_sql("SELECT cls, term, ln(p) - ln(1 - p) AS w FROM (SELECT *, (docs + 1) / (nd2 + 2) AS p FROM fu)", "SELECT cls, ln(max(nd2) / (SELECT sum(nd2) FROM cl)) + sum(ln(1 - (docs + 1) / (nd2 + 2))) AS bias FROM fu GROUP BY 1", "1"))
def bernoulli_nb(t):
    return _nb_query(t, nb.bernoulli_fit, True)


_ALPHAS = (0.01, 0.1, 1.0, 10.0)


@query("nb_alpha_sweep", f"""WITH {_NB}, al AS (SELECT unnest([{", ".join(f"{a}::DOUBLE" for a in _ALPHAS)}]) AS alpha),
    w AS (SELECT alpha, cls, term, ln((n + alpha) / (sum(n) OVER (PARTITION BY alpha, cls) + alpha * count(*) OVER (PARTITION BY alpha, cls))) AS w FROM fu, al), b AS ({_PRIOR}),
    d AS (SELECT alpha, c5.doc_id, w.cls, sum(tf * w.w) AS s FROM c5 JOIN w USING (term) GROUP BY ALL),
    s AS (SELECT al.alpha, lab.doc_id, lab.y, b.cls, bias + coalesce(s, 0) AS score FROM lab CROSS JOIN al CROSS JOIN b LEFT JOIN d ON d.doc_id = lab.doc_id AND d.cls = b.cls AND d.alpha = al.alpha),
    p AS (SELECT alpha, doc_id, any_value(y) AS y, arg_max(cls, round(score, 6) + cls * 1e-9) AS pred FROM s GROUP BY ALL)
    SELECT alpha, doc_id % 5 = 0 AS held_out, {r6("avg(CAST(pred = y AS INT))")} AS accuracy FROM p GROUP BY ALL""")
def nb_alpha_sweep(t):
    docs, train, table = nb_input(t)
    labels = docs.select("doc_id", "y")
    out = None
    # documents meet the weights of all settings in one join
    for a, scores in zip(_ALPHAS, nb.term_scores(docs, "doc_id", table, [nb.multinomial_fit(table, train, "y", a) for a in _ALPHAS])):
        s = nb.best_class(scores, "doc_id").join(labels, "doc_id")
        r = s.groupBy((F.col("doc_id") % 5 == 0).alias("held_out")).agg(rnd(F.avg(flag(F.col("pred") == F.col("y")))).alias("accuracy")).withColumn("alpha", F.lit(a))
        out = r if out is None else out.unionByName(r)
    return out


_CH = """w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_][\\p{L}\\p{N}_]+')) AS w FROM documents), dw AS (SELECT doc_id, lang, w, count(*) AS tf FROM w GROUP BY 1, 2, 3),
    wg AS (SELECT w, unnest(list_concat(list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3)), list_transform(range(1, length(w)), lambda i: substr(' ' || w || ' ', i, 4)))) AS gram FROM (SELECT DISTINCT w FROM dw)),
    wl AS (SELECT lang, w, sum(tf) AS n FROM dw WHERE doc_id % 5 <> 0 GROUP BY 1, 2), gl AS (SELECT lang, gram, sum(n) AS n FROM wl JOIN wg USING (w) GROUP BY 1, 2), gs AS (SELECT gram FROM gl GROUP BY 1), ls AS (SELECT lang, count(*) AS nd FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1),
    tot AS (SELECT lang, sum(n) AS t FROM gl GROUP BY 1), d AS (SELECT count(*) AS d FROM gs),
    ww AS (SELECT ls.lang, wg.w, sum(ln((coalesce(gl.n, 0) + 1) / (t + d))) AS lp FROM wg JOIN gs USING (gram) CROSS JOIN ls JOIN tot ON tot.lang = ls.lang CROSS JOIN d LEFT JOIN gl ON gl.lang = ls.lang AND gl.gram = wg.gram GROUP BY 1, 2),
    sc AS (SELECT dw.doc_id, ww.lang, sum(tf * lp) + max(ln(nd / (SELECT sum(nd) FROM ls))) AS s FROM dw JOIN ww USING (w) JOIN ls ON ls.lang = ww.lang GROUP BY 1, 2)"""


@query("language_id", f"WITH {_CH} SELECT doc_id, arg_max(lang, round(s, 5)) AS pred FROM sc GROUP BY 1")
def language_id(t):
    """Multinomial Bayes on character 3- and 4-grams.

    Words are cut into n-grams once per distinct word; a word's class scores are added up where its documents lie.
    """
    docs = t.documents.select("doc_id", "lang", tx.tokens(F.col("text")).alias("tok"))
    flat = docs.select("lang", (F.col("doc_id") % 5 != 0).alias("train"), tx.each("tok").alias("w"))
    counts = cut(flat.groupBy("lang", "train", "w").agg(F.count(F.lit(1)).alias("n")))
    gram = F.explode(tx.char_ngrams(F.col("w"), 3, 4)).alias("term")
    table = counts.filter("train").select(F.col("lang").alias("cls"), "n", gram).groupBy("cls", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))
    weights, bias = nb.multinomial_fit(table, t.documents.filter("doc_id % 5 <> 0").select("doc_id", "lang"), "lang")
    known = [(r.cls, r.bias) for r in bias.collect()]  # one row per language
    cols = [f"w{i}" for i in range(len(known))]
    grams = counts.groupBy("w").agg(F.sum("n").alias("n")).select("w", "n", gram)
    # n-grams are many rows made of a small table: its size says nothing of theirs
    words = grams.hint("merge").join(nb.wide_weights(weights, [c for c, _ in known]), "term").groupBy("w", "n").agg(*[F.sum(c).alias(c) for c in cols])
    s = nb.summed(docs.select("doc_id", F.inline(tx.run_counts(F.col("tok")))).withColumnsRenamed({"term": "w", "tf": "k"}), "doc_id", "w", words, {c: F.col("k") * F.col(c) for c in cols})
    cells = F.array(*[F.struct(F.round(F.col(f"w{i}") + b, 5).alias("score"), F.lit(c).alias("cls")) for i, (c, b) in enumerate(known)])
    return s.select("doc_id", F.array_max(cells)["cls"].alias("pred"))


# ---- generalised linear, calibration, survival ---------------------------------------------------

def _glm(t, family, **kw):
    r = assembled(reg(t).withColumn("y", F.col("y") if family != "poisson" else F.round("y")), ["x1", "x3"], ["seg"]).cache()
    m = GeneralizedLinearRegression(labelCol="y", family=family, maxIter=15, regParam=1e-3, **kw).fit(r)
    out = [("intercept", float(m.intercept), float(np.exp(m.intercept)))] + [(f"f{i}", float(c), float(np.exp(c))) for i, c in enumerate(m.coefficients)]
    return rows(t.spark, out, "term string, coefficient double, factor double").withColumn("deviance", F.lit(float(m.summary.deviance)))


@query("glm_tweedie")
def glm_tweedie(t):
    return _glm(t, "tweedie", variancePower=1.5, linkPower=0.0)


@query("glm_poisson")
def glm_poisson(t):
    return _glm(t, "poisson", link="log")


@query("glm_gamma")
def glm_gamma(t):
    return _glm(t, "gamma", link="log")


@query("quantile_linear")
def quantile_linear(t):
    r = en.standard_scale(reg(t).select("x1", "x2", "y"), ["x1", "x2"], F.lit(True)).cache()
    qs = (0.1, 0.5, 0.9)
    fits = ln.quantile_fit(r, ["x1", "x2"], "y", qs)
    fitted = {q: ln.dot(["x1", "x2"], w[1:], w[0]) for q, w in zip(qs, fits)}
    row = r.agg(*[F.avg(flag(F.col("y") <= z)) for z in fitted.values()], *[mt.pinball("y", z, q) for q, z in fitted.items()]).first()
    return rows(t.spark, [(q, float(row[i]), float(row[i + len(qs)])) for i, q in enumerate(qs)], "q double, share_below double, pinball double")


IN_TRAIN_SQL = mix("id % 1099511627776", 31) + " < .8::DOUBLE"


@query("isotonic", f"""WITH t AS (SELECT score AS x, avg(y) AS m, count(*) AS w, sum(y) AS s FROM v_scores WHERE {IN_TRAIN_SQL} GROUP BY 1), c AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(s) OVER (ORDER BY x) AS cs, w, s FROM t),
    p AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM c a JOIN c b ON b.i >= a.i), lo AS (SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM p),
    f AS (SELECT c.x, max(lo.m) AS v FROM lo JOIN c ON c.i = lo.b GROUP BY 1),
    q AS (SELECT id, score FROM v_scores WHERE NOT ({IN_TRAIN_SQL})), u AS (SELECT q.id, q.score, f.x AS x0, f.v AS v0 FROM q ASOF LEFT JOIN f ON q.score >= f.x), o AS (SELECT u.*, f.x AS x1, f.v AS v1 FROM u ASOF LEFT JOIN f ON u.score <= f.x)
    SELECT id, {r6("CASE WHEN x0 IS NULL THEN v1 WHEN x1 IS NULL OR x0 = x1 THEN v0 ELSE v0 + (v1 - v0) * (score - x0) / (x1 - x0) END")} AS calibrated FROM o""")
def isotonic(t):
    """Adjacent violators pooled in slices on the train rows; held-out rows read their level between the blocks."""
    s = view(t, "v_scores").select("id", "score", F.col("y").cast("double").alias("y"))
    train, test = halves(s)
    return isotonic_apply(test, isotonic_blocks(train, "score", "y"), "score", "p").select("id", rnd("p").alias("calibrated"))


@query("platt")
def platt(t):
    s = assembled(view(t, "v_scores").select("id", "score", F.col("y").cast("double").alias("y")), ["score"], scale=False)
    train, test = halves(s)
    p = LogisticRegression(labelCol="y").fit(train).transform(test).withColumn("p", p1())
    return p.agg(rnd(mt.log_loss("p", "y")).alias("log_loss"), rnd(F.avg(F.pow(F.col("p") - F.col("y"), 2))).alias("brier"), rnd(F.avg(F.pow(F.col("score") - F.col("y"), 2))).alias("brier_raw"))


def online_steps(df, cols, y, w, rate=0.5, l1=1e-4, l2=1e-4):
    """One mini-batch step from one aggregate over the batch, with elastic-net shrinkage."""
    p = 1 / (1 + F.exp(-ln.dot(cols, w[1:], w[0])))
    err = p - F.col(y)
    row = df.agg(F.avg(err), *[F.avg(err * F.col(c)) for c in cols]).first()
    g = np.array([v or 0.0 for v in row], dtype=float)
    new = w - rate * g
    new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) * (1 - rate * l2) - rate * l1, 0)
    return new


@query("online_logreg")
def online_logreg(t):
    """Warm-started steps over hash batches; the log loss after each batch is reported."""
    d = en.standard_scale(cls(t), ["score", "amount"], F.lit(True)).select("id", "score", "amount", "y").withColumn("b", F.floor(mix_hash("id", 41) * 12)).cache()
    w, out = np.zeros(3), []
    for b in range(12):
        w = online_steps(d.filter(F.col("b") == b), ["score", "amount"], "y", w)
        out.append((b, float(w[0]), float(w[1]), float(w[2])))
    return rows(t.spark, out, "batch int, bias double, w_score double, w_amount double")


@query("factorization_machine")
def factorization_machine(t):
    train, test = halves(cls_vec(t, ("grp", "status")))
    m = FMClassifier(labelCol="y", factorSize=4, maxIter=30, stepSize=0.05, seed=1).fit(train)
    return rows(t.spark, [(auc(m.transform(test)),)], "auc double")


def surv(t):
    s = view(t, "v_surv").join(t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1e4).alias("balance")), "id")
    return s.withColumn("event", F.col("event").cast("double"))


@query("aft_survival")
def aft_survival(t):
    v = assembled(surv(t), ["risk", "balance"], scale=False)
    m = AFTSurvivalRegression(labelCol="duration", censorCol="event", maxIter=30).fit(v)
    return m.transform(v).select("id", rnd("prediction", 4).alias("expected"))


@query("cox_ph")
def cox_ph(t):
    s = surv(t)
    w = ln.cox_fit(s, ["risk", "balance"], "duration", "event")
    return rows(t.spark, [(n, float(b), float(np.exp(b))) for n, b in zip(("risk", "balance"), w)], "term string, coefficient double, hazard_ratio double")


def mills(df, cols, selected):
    """Probit selection model and its correction term phi(z) / Phi(z)."""
    v = assembled(df.withColumn("y", F.col(selected).cast("double")), cols)
    m = GeneralizedLinearRegression(labelCol="y", family="binomial", link="probit", maxIter=20, linkPredictionCol="z").fit(v)
    out = m.transform(v)
    phi = F.exp(-F.col("z") * F.col("z") / 2) / float(np.sqrt(2 * np.pi))
    return out.withColumn("mills", phi / F.greatest("prediction", F.lit(1e-12))).drop("prediction", "z", "features")


@query("inverse_mills")
def inverse_mills(t):
    d = cls(t).withColumn("selected", flag(F.col("amount") + 2 * F.col("noise") > 3))
    return mills(d, ["amount", "score"], "selected").select("id", "selected", rnd("mills").alias("mills"))


@query("heckman_two_step")
def heckman_two_step(t):
    """Outcome model on the selected rows with the correction term as a feature."""
    d = cls(t).withColumn("selected", flag(F.col("amount") + 2 * F.col("noise") > 3)).withColumn("outcome", F.col("y"))
    m = mills(d, ["amount", "score"], "selected").filter("selected = 1").withColumn("y", F.col("outcome"))
    v = assembled(m, ["score", "amount", "mills"])
    f = LinearRegression(labelCol="y").fit(v)
    return rows(t.spark, list(zip(("score", "amount", "mills"), map(float, f.coefficients))), "term string, coefficient double")


# ---- trees ---------------------------------------------------------------------------------------

def _split_sql(kind):
    imp = {"gini": "1 - ({s} / {m}) ^ 2 - (({m} - {s}) / {m}) ^ 2",
           "entropy": "CASE WHEN {s} > 0 THEN -({s} / {m}) * log2({s} / {m}) ELSE 0 END + CASE WHEN {m} - {s} > 0 THEN -(({m} - {s}) / {m}) * log2(({m} - {s}) / {m}) ELSE 0 END",
           "mse": "{q} / {m} - ({s} / {m}) ^ 2"}[kind]
    f = lambda s, q, m: "(" + imp.format(s=s, q=q, m=m) + ")"
    return f"g_{kind} AS (SELECT '{kind}' AS criterion, feature, v, fi, {f('ts', 'tq', 'tn')} - cn / tn * {f('cs', 'cq', 'cn')} - (tn - cn) / tn * {f('(ts - cs)', '(tq - cq)', '(tn - cn)')} AS gain FROM c WHERE cn >= 20 AND tn - cn >= 20)"


_FEATS = ["score", "amount", "month"]
_SPLIT = "f AS (SELECT score, amount / 1e5 AS amount, month(o_orderdate)::DOUBLE AS month, y::DOUBLE AS y FROM v_scores JOIN orders ON id = o_orderkey), l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS fi, {c} AS v, y FROM f" for i, c in enumerate(_FEATS)) + """),
    a AS (SELECT feature, fi, v, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS q FROM l GROUP BY 1, 2, 3), c AS (SELECT *, sum(n) OVER w AS cn, sum(s) OVER w AS cs, sum(q) OVER w AS cq, sum(n) OVER t AS tn, sum(s) OVER t AS ts, sum(q) OVER t AS tq FROM a WINDOW w AS (PARTITION BY feature ORDER BY v), t AS (PARTITION BY feature))"""
_KINDS = ("gini", "entropy", "mse")


@query("split_search", f"WITH {_SPLIT}, {', '.join(_split_sql(k) for k in _KINDS)}, u AS ({' UNION ALL '.join(f'SELECT * FROM g_{k}' for k in _KINDS)}), r AS (SELECT *, row_number() OVER (PARTITION BY criterion ORDER BY round(gain, 9) DESC, fi, v) AS rn FROM u) SELECT criterion, feature, {r6('v')} AS threshold, {r6('gain')} AS gain FROM r WHERE rn = 1")
def split_search(t):
    b = tr.best_split(cls(t).select(*_FEATS, "y"), _FEATS, "y", 20, _KINDS)
    return b.select("criterion", "feature", rnd("threshold").alias("threshold"), rnd("gain").alias("gain"))


@query("tree_classifier")
def tree_classifier(t):
    train, test = halves(cls_vec(t))
    out = []
    for imp in ("gini", "entropy"):
        m = DecisionTreeClassifier(labelCol="y", impurity=imp, maxDepth=5, minInstancesPerNode=5).fit(train)
        out.append((imp, m.depth, m.numNodes, float(MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy").evaluate(m.transform(test)))))
    return rows(t.spark, out, "impurity string, depth int, nodes int, accuracy double")


@query("tree_regressor")
def tree_regressor(t):
    train, test = halves(reg_vec(t))
    m = DecisionTreeRegressor(labelCol="y", maxDepth=6, minInstancesPerNode=5).fit(train)
    return rows(t.spark, [(m.depth, m.numNodes, rmse(m.transform(test)))], "depth int, nodes int, rmse double")


@query("depth_sweep")
def depth_sweep(t):
    train, test = halves(cls_vec(t))
    ev = MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy")
    out = []
    for d in (1, 2, 4, 8, 12):
        m = DecisionTreeClassifier(labelCol="y", maxDepth=d).fit(train)
        out.append((d, float(ev.evaluate(m.transform(train))), float(ev.evaluate(m.transform(test)))))
    return rows(t.spark, out, "depth int, train double, test double")


def forest(**kw):
    return RandomForestClassifier(labelCol="y", numTrees=15, maxDepth=6, seed=1, **kw)


@query("random_forest")
def random_forest(t):
    train, test = halves(cls_vec(t))
    m = forest().fit(train)
    return rows(t.spark, [("classifier", auc(m.transform(test)))], "model string, value double")


@query("random_forest_regressor")
def random_forest_regressor(t):
    train, test = halves(reg_vec(t))
    m = RandomForestRegressor(labelCol="y", numTrees=15, maxDepth=6, seed=1).fit(train)
    return rows(t.spark, [("regressor", rmse(m.transform(test)))], "model string, value double")


@query("oob_score")
def oob_score(t):
    """Each bag's tree votes only on the rows its Poisson weights left out."""
    # the weights are made once: a bag is read once per level of its tree
    v = cls_vec(t, **{f"w{b}": poisson1(mix_hash("id", 100 + b)).cast("double") for b in range(5)})
    votes = None
    for b in range(5):
        bag = v.withColumnRenamed(f"w{b}", "w")
        m = DecisionTreeClassifier(labelCol="y", weightCol="w", maxDepth=6, seed=b).fit(bag.filter("w > 0"))
        part = m.transform(bag.filter("w = 0")).select("id", "y", "prediction")
        votes = part if votes is None else votes.unionByName(part)
    per = votes.groupBy("id", "y").agg(F.avg("prediction").alias("p"), F.count(F.lit(1)).alias("k"))
    return per.agg(F.count(F.lit(1)).alias("rows_voted"), rnd(F.avg(flag(flag(F.col("p") >= .5) == F.col("y")))).alias("oob_accuracy"))


def gbt(n=15, make=None, **kw):
    return (make or GBTClassifier)(labelCol="y", maxIter=n, maxDepth=3, stepSize=kw.pop("stepSize", .2), seed=1, **kw)


@query("gbt_classifier")
def gbt_classifier(t):
    train, test = halves(cls_vec(t))
    return rows(t.spark, [(auc(gbt(subsamplingRate=.8).fit(train).transform(test)),)], "auc double")


@query("gbt_regressor")
def gbt_regressor(t):
    """Boosted on cells: trees see 32 bins of a feature, so train rows in equal bins are one weighted row; judged on the held-out rows themselves."""
    numeric = ["x1", "x2", "x3"]
    v = cut(reg(t).select("id", *numeric, "seg", "y", in_train().alias("train")))
    b = tr.binned(v, tr.bin_edges(v.filter("train"), numeric))
    c = cut(tr.cells(b.filter("train"), [*numeric, "seg"], "y", "id"))
    stages = Pipeline(stages=feature_stages(numeric, ["seg"])).fit(c)
    m = GBTRegressor(labelCol="y", weightCol="n", maxIter=15, maxDepth=4, stepSize=.2, subsamplingRate=.8, seed=1).fit(spread(stages.transform(c), c.count(), "features").cache())
    out = rmse(m.transform(stages.transform(b.filter("not train"))))
    release(v, c)
    return rows(t.spark, [(out,)], "rmse double")


@query("staged_eval")
def staged_eval(t):
    train, test = halves(cls_vec(t))
    m = gbt(20).fit(train)
    return rows(t.spark, list(zip(range(1, 21), map(float, m.evaluateEachIteration(train)), map(float, m.evaluateEachIteration(test)))), "trees int, train_loss double, test_loss double")


@query("early_stopping")
def early_stopping(t):
    v = halves(cls_vec(t))[0].withColumn("is_val", mix_hash("id", 51) < .2)
    m = gbt(40, validationIndicatorCol="is_val", validationTol=.01, stepSize=.3).fit(v)
    return rows(t.spark, [(m.getNumTrees, 40)], "trees_kept int, trees_allowed int")


#: What else is swept, at one step on all rows: depths, and the values of lambda and of alpha
DEPTHS, PENALTIES = (2, 3, 4, 6), (0.0, .1, 1.0, 10.0)


@query("boosted_sweeps")
def boosted_sweeps(t):
    """Step by subsample, judged by their area; depth, lambda and alpha, judged by train and test accuracy and log loss, in the row of the setting they are swept at.

    Boosted and judged on cells, as trees see 32 bins of a feature: rows in equal bins, of one group and label, are one row with their count.
    A subsample still takes or leaves every row by itself.
    """
    v = cut(cls(t).select(*NUM, "grp", "y", in_train().alias("train")))
    b = tr.binned(v, tr.bin_edges(v.filter("train"), NUM))
    c = cut(tr.counted_cells(b, [*NUM, "grp", "y", "train"], parts=1))
    groups = StringIndexer(inputCol="grp", outputCol="_g", handleInvalid="keep", stringOrderType="alphabetAsc").fit(c.filter("train"))
    cols = [*NUM, "grp"]
    cells = spread(groups.transform(c).withColumn("grp", F.col("_g").cast("int")).drop("_g"), c.count(), cols).cache()
    train, test = cells.filter("train"), cells.filter("not train")
    make = bo.on_cells(GBTClassifier, cols, ["grp"])
    settings = [(step, sub) for step in (.05, .3) for sub in (.5, 1.0)]
    at = settings[-1]
    wide = [[bo.Setting(at[0], depth=d) for d in DEPTHS], [bo.Setting(at[0], l2=x) for x in PENALTIES], [bo.Setting(at[0], l2=0.0, l1=x) for x in PENALTIES]]
    # the setting itself is among them, and is fitted below
    own = bo.Setting(at[0])
    apart = sorted({s for sweep in wide for s in sweep} - {own}, key=repr)

    def fitted(setting):
        return gbt(10, make, stepSize=setting[0], subsamplingRate=setting[1], weightCol="n").fit(train)

    # a fit is many short jobs: the fits share the cluster
    with ThreadPoolExecutor(len(settings) + 1) as pool:
        effects = pool.submit(bo.boost, train, cols, ["grp"], apart)
        models = list(pool.map(fitted, settings))
        effects = effects.result()
    hits = bo.judged(cells, [models[-1], *effects], "train")
    place = {s: i for i, s in enumerate([own, *apart])}
    swept = [[(x, *hits[place[s], True], *hits.get((place[s], False), (None, None))) for x, s in zip(xs, sweep)] for xs, sweep in zip((DEPTHS, PENALTIES, PENALTIES), wide)]
    out = [(*setting, auc(m.transform(test), weight="n"), *(swept if setting == at else [None] * 3)) for setting, m in zip(settings, models)]
    cells.unpersist()
    release(v, c)
    effect = "array<struct<{}: {}, train: double, train_loss: double, test: double, test_loss: double>>".format
    return rows(t.spark, out, f"step double, subsample double, auc double, by_depth {effect('depth', 'int')}, by_lambda {effect('lambda', 'double')}, by_alpha {effect('alpha', 'double')}")


@query("impurity_importance")
def impurity_importance(t):
    v = assembled(cls(t), NUM, scale=False).cache()
    m = forest().fit(v)
    return rows(t.spark, list(zip(NUM, map(float, m.featureImportances.toArray()))), "feature string, importance double").orderBy(F.desc("importance"))


@query("permutation_importance")
def permutation_importance(t):
    """Loss of AUC on held-out rows when one column is replaced by another row's value, matched by two hash orders."""
    train, d = halves(cls(t).select("id", "y", *NUM))
    d = cut(d)
    m = forest().fit(assembled(train, NUM, scale=False))
    base = auc(m.transform(assembled(d, NUM, scale=False)))
    from larkspur.operators.prefix import numbered
    here = numbered(d.withColumn("h", mix_hash("id", 61)), "h", "id", (), "a").drop("h", "a_total").cache()
    there = numbered(d.withColumn("h", mix_hash("id", 62)), "h", "id", (), "a").select("a", *[F.col(c).alias(f"s_{c}") for c in NUM]).cache()
    mixed = here.join(there, "a")
    out = []
    for c in NUM:
        s = assembled(mixed.withColumn(c, F.col(f"s_{c}")), NUM, scale=False)
        out.append((c, base - auc(m.transform(s))))
    return rows(t.spark, out, "feature string, drop double")


@query("partial_dependence")
def partial_dependence(t):
    d = cls(t).select("id", "y", *NUM).cache()
    m = forest().fit(assembled(d, NUM, scale=False))
    grid = d.withColumn("score", F.explode(F.array(*[F.lit(i / 10) for i in range(1, 10)])))
    p = m.transform(assembled(grid, NUM, scale=False))
    return p.groupBy(F.col("score").alias("grid")).agg(rnd(F.avg(p1())).alias("mean_p"))


@query("isolation_score")
def isolation_score(t):
    return tr.isolation_score(t.events.select("event_id", "value", F.hour("ts").alias("hour")), "event_id", ["value", "hour"], trees=10, sample=64).select("event_id", rnd("score").alias("score"))


# ---- selection, search, comparison ---------------------------------------------------------------

@query("assemble_features")
def assemble_features(t):
    v = assembled(cls(t), NUM, ("grp", "status"))
    a = vector_to_array("features")
    return v.select("id", F.size(a).alias("width"), rnd(F.aggregate(a, F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("select_k_best")
def select_k_best(t):
    v = assembled(cls(t), NUM, scale=False).cache()
    s = UnivariateFeatureSelector(featuresCol="features", outputCol="kept", labelCol="y", selectionMode="numTopFeatures")
    m = s.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(2).fit(v)
    return rows(t.spark, [(NUM[i],) for i in m.selectedFeatures], "feature string")


@query("rfe")
def rfe(t):
    """Drop the weakest feature by forest importance until two are left."""
    v = assembled(cls(t), NUM, scale=False).withColumnRenamed("features", "whole").cache()
    kept, out = list(range(len(NUM))), []
    while len(kept) > 2:
        m = forest().fit(VectorSlicer(inputCol="whole", outputCol="features", indices=kept).transform(v))
        worst = int(m.featureImportances.toArray().argmin())
        out.append((len(kept), NUM[kept[worst]]))
        kept.pop(worst)
    return rows(t.spark, out + [(2, ",".join(NUM[i] for i in kept))], "features_left int, dropped_or_kept string")


@query("l1_select")
def l1_select(t):
    v, _ = halves(assembled(cls(t), NUM, train=in_train()))
    m = LogisticRegression(labelCol="y", elasticNetParam=1.0, regParam=.02, maxIter=30).fit(v)
    return rows(t.spark, [(n, float(c)) for n, c in zip(NUM, m.coefficients) if abs(c) > 1e-9], "feature string, weight double")


def folded(t):
    """Raw rows with five stratified folds: the feature stages are fitted inside each fold."""
    return cut(spread(kfold(cls(t), "id", 5, ["y"]), t.orders.count()))


def crossed(rows, est, maps, evaluator, numeric, cats):
    """Feature stages and the model as one estimator, refitted for every fold."""
    whole = Pipeline(stages=[*feature_stages(numeric, cats), est])
    return CrossValidator(estimator=whole, estimatorParamMaps=maps, evaluator=evaluator, numFolds=5, foldCol="fold", parallelism=4).fit(rows)


def bakeoff(task, models, train, held, evaluator, numeric, cats, folds=5):
    """Rows of :func:`model_bakeoff`: the models of a fold share its feature stages and its vectors, and are fitted side by side."""
    def judged(learn, judge, at_once):
        t0 = time.time()
        stages = Pipeline(stages=feature_stages(numeric, cats)).fit(learn)
        a, b = (stages.transform(d).select("y", "features").cache() for d in (learn, judge))
        a.count()
        made = time.time() - t0

        def one(est):
            t1 = time.time()
            model = est.fit(a)
            spent = time.time() - t1
            return float(evaluator.evaluate(model.transform(b))), made + spent

        with ThreadPoolExecutor(at_once) as pool:
            found = list(pool.map(one, models.values()))
        a.unpersist()
        b.unpersist()
        return found

    per_fold = [judged(train.filter(F.col("fold") != i), train.filter(F.col("fold") == i), len(models)) for i in range(folds)]
    whole = judged(train, held, 1)
    return [(task, name, float(np.mean(cv)), float(np.std(cv)), *whole[m]) for m, name in enumerate(models) for cv in [[f[m][0] for f in per_fold]]]


def like_moments(spark, n, mean, cov):
    """Few weighted rows ``z`` with this count, mean and covariance: a least-squares fit, or the error of a linear model, takes nothing else of the rows."""
    values, axes = np.linalg.eigh(cov)
    steps = (axes * np.sqrt(np.maximum(values, 0) * len(mean))).T
    points = np.concatenate([mean + steps, mean - steps])
    return spark.createDataFrame([(Vectors.dense(z[:-1]), float(z[-1]), n / len(points)) for z in points], ["features", "y", "w"])


def bakeoff_on_sums(task, models, v, numeric, cat, folds=5):
    """:func:`bakeoff` of regressors by the error's root, on sums: ``v`` holds y, ``train`` and ``fold``.

    Linear models are fitted and judged on rows with the moments of a fold's rows, all folds' moments from one pass.  A tree sees
    bins, made per fold: it is fitted on cells of equal bins, and judged on them with what varies inside a cell.
    """
    spark, every = v.sparkSession, [*numeric, "y"]
    start = time.time()
    near = v.filter("train").agg(*[F.avg(c).alias(c) for c in every]).first()
    off = {c: F.col(c) - F.lit(float(near[c] or 0)) for c in every}
    pairs = [(i, j) for i in range(len(every)) for j in range(i + 1)]
    sums = [F.sum(off[c]) for c in every] + [F.sum(off[every[i]] * off[every[j]]) for i, j in pairs]
    whole = v.dropna(subset=every)
    found = [(r[0], r[1], r[2], r[3], np.array(r[4:], float)) for r in whole.groupBy("train", "fold", cat).agg(F.count(F.lit(1)), *sums).collect()]

    def moments(picked, groups):
        """(count, mean, covariance) of the numbers, the groups' flags and y."""
        d, k = len(every), len(groups)
        total, outer = np.zeros(d + k), np.zeros((d + k, d + k))
        n = sum(r[3] for r in picked)
        for _, _, g, m, s in picked:
            at = len(numeric) + groups.index(g if g in groups else None)
            of = [*range(len(numeric)), d + k - 1]
            total[of] += s[:d]
            total[at] += m
            outer[at, at] += m
            outer[at, of] += s[:d]
            outer[of, at] += s[:d]
            for (i, j), x in zip(pairs, s[d:]):
                outer[of[i], of[j]] += x
                if i != j:
                    outer[of[j], of[i]] += x
        mean = total / n
        return n, mean, outer / n - np.outer(mean, mean)

    passed = (time.time() - start) / (folds + 1)

    def judged(learn, judge, ours, theirs):
        t0 = time.time()
        groups = [*sorted({r[2] for r in ours if r[2] is not None}), None]
        (n, mean, cov), (m, mean_b, cov_b) = moments(ours, groups), moments(theirs, groups)
        # scaled by the learners' mean and deviation, as the feature stages scale; y goes back to its own level
        scale, shift = np.ones(len(mean)), np.zeros(len(mean))
        sd = np.sqrt(np.diag(cov)[:len(numeric)] * n / max(n - 1, 1))
        scale[:len(numeric)], shift[:len(numeric)] = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0), mean[:len(numeric)]
        shift[-1] = -float(near["y"] or 0)
        a, b = (like_moments(spark, *x) for x in ((n, (mean - shift) * scale, cov * np.outer(scale, scale)), (m, (mean_b - shift) * scale, cov_b * np.outer(scale, scale))))
        linear = passed + time.time() - t0
        t0 = time.time()
        part = whole.withColumn("learns", F.when(learn, True).when(judge, False)).filter("learns IS NOT NULL")
        cells = tr.binned(part, tr.bin_edges(part.filter("learns"), numeric)).groupBy(*numeric, cat, "learns")
        cells = cut(cells.agg(F.avg("y").alias("y"), F.var_pop("y").alias("inside"), F.count(F.lit(1)).cast("double").alias("w")))
        made = Pipeline(stages=feature_stages(numeric, [cat])).fit(cells.filter("learns")).transform(cells)
        binned = time.time() - t0

        out = []
        for est in models.values():
            on_moments = isinstance(est, LinearRegression)
            t1 = time.time()
            model = est.copy({est.weightCol: "w"}).fit(a if on_moments else made.filter("learns"))
            spent = (linear if on_moments else binned) + time.time() - t1
            at = model.transform(b if on_moments else made.filter("not learns"))
            inside = F.lit(0.0) if on_moments else F.col("inside")
            error = at.agg(F.sqrt(F.sum(F.col("w") * ((F.col("y") - F.col("prediction")) ** 2 + inside)) / F.sum("w"))).first()[0]
            out.append((float(error), spent))
        release(cells)
        return out

    train, fold = F.col("train"), F.col("fold")
    per_fold = [judged(train & (fold != i), train & (fold == i), [r for r in found if r[0] and r[1] != i], [r for r in found if r[0] and r[1] == i]) for i in range(folds)]
    last = judged(train, ~train, [r for r in found if r[0]], [r for r in found if not r[0]])
    return [(task, name, float(np.mean(cv)), float(np.std(cv)), *last[m]) for m, name in enumerate(models) for cv in [[f[m][0] for f in per_fold]]]


@query("model_bakeoff")
def model_bakeoff(t):
    """Classifiers and regressors under the same five folds, preprocessing fitted per fold: mean and deviation of the score, test score, seconds of one fit."""
    auc_of = rk.AreaUnderRoc()
    classifiers = {"logreg": LogisticRegression(labelCol="y", maxIter=15), "tree": DecisionTreeClassifier(labelCol="y", maxDepth=4), "forest": forest(), "svm": LinearSVC(labelCol="y", maxIter=10)}
    regressors = {"linear": LinearRegression(labelCol="y"), "ridge": LinearRegression(labelCol="y", regParam=.1), "tree": DecisionTreeRegressor(labelCol="y", maxDepth=5)}
    out = bakeoff("auc", classifiers, *halves(folded(t)), auc_of, NUM, ("grp",))
    lines = cut(kfold(reg(t).select("id", "x1", "x2", "x3", "seg", "y"), "id", 5).withColumn("train", in_train()))
    out += bakeoff_on_sums("rmse", regressors, lines, ["x1", "x2", "x3"], "seg")
    release(lines)
    return rows(t.spark, out, "score string, model string, cv_mean double, cv_std double, test double, fit_seconds double")


def _search(t, grid):
    est = DecisionTreeClassifier(labelCol="y")
    maps = [{est.maxDepth: d, est.minInstancesPerNode: m} for d, m in grid]
    m = crossed(halves(folded(t))[0], est, maps, rk.AreaUnderRoc(), NUM, ("grp",))
    return rows(t.spark, [(d, k, float(s)) for (d, k), s in zip(grid, m.avgMetrics)], "max_depth int, min_rows int, auc double").orderBy(F.desc("auc"))


@query("grid_search")
def grid_search(t):
    return _search(t, [(d, m) for d in (3, 6) for m in (1, 20)])


@query("random_search")
def random_search(t):
    rng = np.random.default_rng(5)
    return _search(t, [(int(rng.integers(2, 9)), int(rng.integers(1, 40))) for _ in range(4)])


@query("nested_cv")
def nested_cv(t):
    """Outer folds score, inner folds choose the penalty."""
    # read, joined and held once, by what the fits read alone: the validator holds every fold once more
    c = cut(cls(t).select("id", *NUM, "grp", "y"))
    made = spread(assembled(c, NUM, ("grp",), train=in_train()).select("id", "y", "features"), t.orders.count())
    v = with_fold(made, "id", 3, "outer").withColumn("inner", F.floor(mix_hash("id", 71) * 2).cast("int")).drop("id").cache()
    est = LogisticRegression(labelCol="y", maxIter=10)
    grid = ParamGridBuilder().addGrid(est.regParam, [.001, .1]).build()
    out = []
    for i in range(3):
        cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=rk.AreaUnderRoc(), numFolds=2, foldCol="inner", parallelism=2)
        m = cv.fit(v.filter(F.col("outer") != i))
        out.append((i, float(m.bestModel.getRegParam()), auc(m.transform(v.filter(F.col("outer") == i)))))
    v.unpersist()
    release(c)
    return rows(t.spark, out, "fold int, chosen double, auc double")


# ---- compositions --------------------------------------------------------------------------------

@query("stacking")
def stacking(t):
    """Out-of-fold base probabilities become the features of a linear meta model."""
    v = cls_vec(t)
    lr = out_of_fold(v, lambda: LogisticRegression(labelCol="y", maxIter=15), "id", p1(), "p_lr")
    rf = out_of_fold(v, forest, "id", p1(), "p_rf")
    meta = assembled(v.select("id", "y").join(lr, "id").join(rf, "id"), ["p_lr", "p_rf"], scale=False)
    train, test = halves(meta)
    m = LogisticRegression(labelCol="y").fit(train)
    return rows(t.spark, [(float(m.coefficients[0]), float(m.coefficients[1]), auc(m.transform(test)))], "w_logreg double, w_forest double, auc double")


@query("hurdle_model")
def hurdle_model(t):
    """P(any loss) times the expected loss given one, fitted on the log scale; judged on rows that neither model saw."""
    # the amount is a factor of the loss itself, so it is no feature
    v = assembled(cls(t), [c for c in NUM if c != "amount"], ["grp"], train=in_train()).withColumn("loss", F.col("y") * F.col("amount")).cache()
    train, v = halves(v)
    p = LogisticRegression(labelCol="y", maxIter=20).fit(train)
    pos = train.filter("y = 1").withColumn("log_loss", F.log1p("loss"))
    m = LinearRegression(labelCol="log_loss", predictionCol="log_amount").fit(pos)
    out = m.transform(p.transform(v).withColumn("p", p1()))
    e = F.col("p") * F.expm1("log_amount")
    return out.agg(rnd(F.sum(e), 2).alias("expected"), rnd(F.sum("loss"), 2).alias("actual"), rnd(F.corr(e, F.col("loss"))).alias("corr"))


@query("two_stage_router")
def two_stage_router(t):
    """A classifier picks the price regime, a regression per regime gives the value; judged on held-out rows."""
    r, test = halves(reg_vec(t).withColumn("long", flag(F.col("y") > 40).cast("double")).cache())
    c = LogisticRegression(labelCol="long", maxIter=20, predictionCol="regime").fit(r)
    low = LinearRegression(labelCol="y", predictionCol="p_low").fit(r.filter("long = 0"))
    high = LinearRegression(labelCol="y", predictionCol="p_high").fit(r.filter("long = 1"))
    s = high.transform(low.transform(c.transform(test))).withColumn("p", F.when(F.col("regime") == 1, F.col("p_high")).otherwise(F.col("p_low")))
    return s.groupBy(F.col("regime").cast("int").alias("regime")).agg(F.count(F.lit(1)).alias("n"), rnd(F.sqrt(F.avg(F.pow(F.col("p") - F.col("y"), 2)))).alias("rmse"))


def text_vec(t):
    """Documents with simple text measures and three tags."""
    c = F.col("text")
    s = tx.text_stats(c)
    d = view(t, "v_text").select("doc_id", *[s[n].cast("double").alias(n) for n in ("word_count", "avg_word_len", "uppercase_ratio", "digit_ratio", "special_ratio")],
                                 F.col("y").cast("double").alias("good"), F.col("toxic").cast("double").alias("toxic"), (F.col("lang") == "fr").cast("double").alias("fr"))
    return assembled(d, ["word_count", "avg_word_len", "uppercase_ratio", "digit_ratio", "special_ratio"], train=in_train("doc_id")).cache()


@query("ovr_multilabel")
def ovr_multilabel(t):
    v, out = text_vec(t), None
    for tag in ("good", "toxic", "fr"):
        p = out_of_fold(v, lambda tag=tag: LogisticRegression(labelCol=tag, maxIter=20), "doc_id", p1(), "p")
        p = p.select("doc_id", F.lit(tag).alias("tag"), rnd("p").alias("p"))
        out = p if out is None else out.unionByName(p)
    return out


@query("classifier_chain")
def classifier_chain(t):
    """Tags in order of frequency: each model learns from the true tags before it and scores from the predicted ones, on held-out rows."""
    v, test = halves(text_vec(t), "doc_id")
    freq = v.agg(*[F.sum(c).alias(c) for c in ("good", "toxic", "fr")]).first().asDict()
    cols, out = ["features"], []
    for tag in sorted(freq, key=lambda c: (-freq[c], c)):
        from pyspark.ml.feature import VectorAssembler
        learn = VectorAssembler(inputCols=cols, outputCol="chain")
        m = LogisticRegression(labelCol=tag, featuresCol="chain", maxIter=20).fit(learn.transform(v))
        seen = VectorAssembler(inputCols=["features", *[f"_p_{c}" for c in cols[1:]]], outputCol="chain")
        scored = m.transform(seen.transform(test))
        out.append((tag, len(cols) - 1, rk.AreaUnderRoc(tag).evaluate(scored)))
        test = scored.withColumn(f"_p_{tag}", F.col("prediction")).drop("chain", "rawPrediction", "probability", "prediction")
        cols.append(tag)
    return rows(t.spark, out, "tag string, earlier int, auc double")


@query("ordinal_cumulative")
def ordinal_cumulative(t):
    """One model per threshold P(rank > k), turned into class probabilities by differences, on held-out rows."""
    from larkspur.plans.columns import PRIORITY_RANK
    ranks = F.create_map(*[F.lit(x) for kv in PRIORITY_RANK.items() for x in kv])
    v = assembled(cls(t).withColumn("rank", ranks[F.col("grp")] - 1), NUM, train=in_train()).cache()
    learn, out = halves(v)
    tails = []
    for k in range(4):
        lab = learn.withColumn("y", (F.col("rank") > k).cast("double"))
        m = LogisticRegression(labelCol="y", maxIter=10, probabilityCol=f"pr{k}", rawPredictionCol=f"rw{k}", predictionCol=f"pd{k}").fit(lab)
        out = m.transform(out)
        tails.append(p1(f"pr{k}"))
    probs = [1 - tails[0], *[tails[k - 1] - tails[k] for k in range(1, 4)], tails[3]]
    return out.select("id", "rank", *[rnd(p, 5).alias(f"p{i}") for i, p in enumerate(probs)])


@query("head_tail_router", """WITH p AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'REJECT' END AS head, ((event_id * 7919) % 1009) / 1009.0::DOUBLE AS p FROM events),
    k AS (SELECT p.event_id, c.label, ((p.event_id * c.m) % 97) / 97.0::DOUBLE AS w FROM p, (VALUES ('click', 31), ('view', 57), ('error', 71), ('signup', 83)) c(label, m)),
    s AS (SELECT event_id, head AS label, p AS w FROM p WHERE head <> 'REJECT' UNION ALL SELECT k.event_id, label, CASE WHEN head = 'REJECT' THEN w ELSE w * .5::DOUBLE END FROM k JOIN p USING (event_id) WHERE head = 'REJECT' OR p < .55), g AS (SELECT event_id, label, sum(w) AS w FROM s GROUP BY 1, 2)
    SELECT event_id, label FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(w, 9) DESC, label) AS rn FROM g) WHERE rn = 1""")
def head_tail_router(t):
    """Confident head classes stay; rejected rows use the neighbour votes; unsure ones blend both (votes halved)."""
    e = t.events.select("event_id", F.when(F.col("event_type").isin("click", "view", "purchase"), F.col("event_type")).otherwise("REJECT").alias("head"), (((F.col("event_id") * 7919) % 1009) / F.lit(1009.0)).alias("p"))
    reject, unsure = F.col("head") == "REJECT", F.col("p") < .55
    votes = F.array(*[F.struct(F.lit(c).alias("label"), (((F.col("event_id") * m) % 97) / F.lit(97.0) * F.when(reject, 1.0).otherwise(.5)).alias("w")) for c, m in (("click", 31), ("view", 57), ("error", 71), ("signup", 83))])
    own = F.array(F.struct(F.col("head").alias("label"), F.col("p").alias("w")))
    cells = F.when(reject, votes).when(unsure, F.concat(own, votes)).otherwise(own)
    g = e.select("event_id", F.explode(cells).alias("c")).groupBy("event_id", "c.label").agg(F.sum("c.w").alias("w"))
    return g.groupBy("event_id").agg(F.min_by("label", F.struct((-F.round("w", 9)).alias("k"), "label")).alias("label"))


def both_arms(v, m1, m0):
    ren = lambda df, n: df.withColumn(n, p1()).drop("probability", "rawPrediction", "prediction")
    return ren(m0.transform(ren(m1.transform(v), "p1")), "p0")


def _by_fold(t, effect, k=3):
    """Every row's effect from models of the other folds: ``effect(learn, score)`` returns (id, uplift) of ``score``."""
    v, out = cut(with_fold(cls_vec(t), "id", k, "_fold")), None
    for i in range(k):
        part = effect(v.filter(F.col("_fold") != i), v.filter(F.col("_fold") == i))
        out = part if out is None else out.unionByName(part)
    return out


def _arms(learn):
    return [gbt(8).fit(learn.filter(F.col("treatment") == a)) for a in (1, 0)]


@query("t_learner")
def t_learner(t):
    """A model per arm; each row is scored by models that did not see it."""
    return _by_fold(t, lambda learn, score: both_arms(score, *_arms(learn)).select("id", rnd(F.col("p1") - F.col("p0")).alias("uplift")))


@query("x_learner")
def x_learner(t):
    """Pseudo-effects of each arm regressed on the features, mixed by the propensity; each row is scored by models that did not see it."""
    def effect(learn, score):
        s = both_arms(learn, *_arms(learn)).cache()
        fit = lambda df, e, n: GBTRegressor(labelCol="e", maxIter=6, maxDepth=3, predictionCol=n, seed=1).fit(df.withColumn("e", e))
        t1 = fit(s.filter("treatment = 1"), F.col("y") - F.col("p0"), "tau1")
        t0 = fit(s.filter("treatment = 0"), F.col("p1") - F.col("y"), "tau0")
        g = LogisticRegression(labelCol="arm", maxIter=10).fit(s.withColumn("arm", F.col("treatment").cast("double")))
        s.unpersist()
        out = g.transform(t0.transform(t1.transform(score)))
        return out.select("id", rnd(p1() * F.col("tau0") + (1 - p1()) * F.col("tau1")).alias("uplift"))

    return _by_fold(t, effect)


@query("label_noise_scan")
def label_noise_scan(t):
    """Every negative with its out-of-fold score; above .95 it goes to review."""
    v = cls_vec(t)
    p = out_of_fold(v, lambda: DecisionTreeClassifier(labelCol="y", maxDepth=5), "id", p1(), "p")
    return v.select("id", "y").join(p, "id").filter("y = 0").select("id", rnd("p").alias("p"), flag(F.col("p") > .95).alias("review"))


@query("lifetime_value")
def lifetime_value(t):
    """Expected lifetime of the segment (capped at the horizon) times the predicted monthly spend."""
    k = sv.kaplan_meier(view(t, "v_surv"), "duration", "event", ["grp"])
    from larkspur.operators.windows import over_rows
    k = over_rows(k, ["grp"], "duration", "duration", lambda w: {"t0": F.lag("duration", 1, 0.0).over(w), "s0": F.lag("survival", 1, 1.0).over(w)}, before=1)
    life = k.groupBy("grp").agg(F.least(F.sum((F.col("duration") - F.col("t0")) * (F.col("survival") + F.col("s0")) / 2), F.lit(36.0)).alias("months"))
    spend = t.orders.groupBy("o_custkey").agg((F.sum("o_totalprice") / 79).alias("y"), F.count(F.lit(1)).cast("double").alias("orders"))
    # a customer without orders has spent nothing; a segment without a curve lives for no expected month
    d = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("grp"), "c_acctbal").join(spend, F.col("id") == F.col("o_custkey"), "left").fillna(0.0, ["y", "orders"])
    v = assembled(d, ["c_acctbal", "orders"], ["grp"], train=in_train())
    m = out_of_fold(v, lambda: LinearRegression(labelCol="y"), "id", F.col("prediction"), "prediction").join(d.select("id", "grp"), "id")
    return m.join(life, m["grp"].eqNullSafe(life["grp"]), "left").fillna(0.0, ["months"]).select("id", rnd("months", 4).alias("months"), rnd(F.col("months") * F.greatest("prediction", F.lit(0.0)), 2).alias("value"))


@query("randomization_auc")
def randomization_auc(t):
    """A classifier of the arm should do no better than chance."""
    learn, v = halves(assembled(cls(t), ["score", "amount", "month"], train=in_train()).withColumn("arm", F.col("treatment").cast("double")))
    m = LogisticRegression(labelCol="arm", maxIter=10).fit(learn)
    return rk.roc_auc(m.transform(v).select(p1().alias("score"), F.col("treatment").alias("y"))).select(rnd("auc").alias("auc"))
