"""Evaluation tables over predictions."""

from pyspark.sql import Window as W, functions as F

from larkspur.functions.scalar import flag, ratio, rnd
from larkspur.metrics import ranking as rk, survival as sv, tables as mt
from larkspur.operators.clean import attach_one, quantile_bins
from larkspur.operators.prefix import average_rank, exact_quantiles, global_cumsum
from larkspur.operators.windows import over_rows
from larkspur.plans.columns import PRIORITY_RANK
from larkspur.plans.registry import query, r6
from larkspur.plans.series import DAY_US, _HOURLY, events, hourly
from larkspur.plans.views import view

_HIT = "CAST(score >= 0.5 AS INT)"


def scored(t, cut=0.5):
    return view(t, "v_scores").withColumn("pred", flag(F.col("score") >= cut))


@query("confusion_matrix", f"SELECT y AS actual, {_HIT} AS predicted, count(*) AS n FROM v_scores GROUP BY 1, 2")
def confusion_matrix(t):
    return mt.confusion(scored(t), "y", "pred")


_REPORT = f"""c AS (SELECT y, {_HIT} AS p FROM v_scores), k AS (SELECT cls, (SELECT count(*) FROM c WHERE y = cls) AS support, (SELECT count(*) FROM c WHERE p = cls) AS called, (SELECT count(*) FROM c WHERE y = cls AND p = cls) AS tp FROM (VALUES (0), (1)) v(cls)),
    r AS (SELECT *, tp / called AS precision, tp / support AS recall, 2 * tp / (called + support) AS f1 FROM k)"""


@query("classification_report", f"""WITH {_REPORT} SELECT CAST(cls AS VARCHAR) AS cls, CAST(support AS BIGINT) AS support, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1 FROM r
    UNION ALL SELECT 'macro', CAST(sum(support) AS BIGINT), {r6('avg(precision)')}, {r6('avg(recall)')}, {r6('avg(f1)')} FROM r
    UNION ALL SELECT 'weighted', CAST(sum(support) AS BIGINT), {r6('sum(precision * support) / sum(support)')}, {r6('sum(recall * support) / sum(support)')}, {r6('sum(f1 * support) / sum(support)')} FROM r
    UNION ALL SELECT 'micro', CAST(sum(support) AS BIGINT), {r6('sum(tp) / sum(support)')}, {r6('sum(tp) / sum(support)')}, {r6('sum(tp) / sum(support)')} FROM r""")
def classification_report(t):
    r = mt.class_report(mt.confusion(scored(t), "y", "pred"))
    out = lambda name, f: r.agg(F.lit(name).alias("cls"), F.sum("support").alias("support"), *[rnd(f(c)).alias(c) for c in ("precision", "recall", "f1")])
    per = r.select(F.col("cls").cast("string").alias("cls"), "support", *[rnd(c).alias(c) for c in ("precision", "recall", "f1")])
    return (per.unionByName(out("macro", F.avg)).unionByName(out("weighted", lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")))
            .unionByName(out("micro", lambda c: F.sum("tp") / F.sum("support"))))


@query("fbeta", f"WITH {_REPORT} SELECT {', '.join(r6(f'(1 + {b} * {b}) * precision * recall / ({b} * {b} * precision + recall)') + f' AS {n}' for b, n in ((0.5, 'f_half'), (1.0, 'f_one'), (2.0, 'f_two')))} FROM r WHERE cls = 1")
def fbeta(t):
    r = mt.binary_rates("y", "pred")
    s = scored(t).agg(r["precision"].alias("p"), r["recall"].alias("r"))
    return s.select(*[rnd(mt.fbeta(F.col("p"), F.col("r"), b)).alias(n) for b, n in ((0.5, "f_half"), (1.0, "f_one"), (2.0, "f_two"))])


_ST = """s AS (SELECT score, count(*) AS n, sum(y) AS pos FROM v_scores GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS cn, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(n) OVER () AS tn, sum(pos) OVER () AS tp FROM s)"""


@query("roc_points", f"WITH {_ST} SELECT {r6('score')} AS score, {r6('cp / tp')} AS tpr, {r6('(cn - cp) / (tn - tp)')} AS fpr FROM c")
def roc_points(t):
    return rk.with_rates(rk.score_table(view(t, "v_scores"))).select(rnd("score").alias("score"), rnd("tpr").alias("tpr"), rnd("fpr").alias("fpr"))


_AUC = "(sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * (count(*) - sum(y)))"


@query("roc_auc", f"WITH a AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM v_scores) SELECT {r6(_AUC)} AS auc FROM a")
def roc_auc(t):
    return rk.roc_auc(view(t, "v_scores")).select(rnd("auc").alias("auc"))


@query("pr_points", f"WITH {_ST} SELECT {r6('score')} AS score, {r6('cp / cn')} AS precision, {r6('cp / tp')} AS recall FROM c")
def pr_points(t):
    return rk.with_rates(rk.score_table(view(t, "v_scores"))).select(rnd("score").alias("score"), rnd("precision").alias("precision"), rnd("recall").alias("recall"))


@query("avg_precision", f"WITH {_ST} SELECT {r6('sum(pos / tp * cp / cn)')} AS ap FROM c")
def avg_precision(t):
    return rk.average_precision(view(t, "v_scores")).select(rnd("ap").alias("ap"))


@query("log_loss", f"WITH p AS (SELECT y, least(greatest(score, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS p FROM v_scores) SELECT {r6('-avg(y * ln(p) + (1 - y) * ln(1 - p))')} AS log_loss FROM p")
def log_loss(t):
    return view(t, "v_scores").agg(rnd(mt.log_loss("score", "y")).alias("log_loss"))


@query("brier", f"SELECT {r6('avg((score - y) ^ 2)')} AS brier FROM v_scores")
def brier(t):
    return view(t, "v_scores").agg(rnd(F.avg(F.pow(F.col("score") - F.col("y"), 2))).alias("brier"))


_UBIN = "b AS (SELECT CAST(least(floor(score * 10), 9) AS INT) AS bin, count(*) AS n, avg(score) AS mean_p, avg(y) AS rate FROM v_scores GROUP BY 1)"
_QBIN = """e AS (SELECT list_sort(list_distinct(quantile_cont(score, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS edges FROM v_scores),
    x AS (SELECT v.*, CAST(len(list_filter(edges[2:len(edges)-1], lambda z: z < score)) AS INT) AS bin FROM v_scores v, e)"""


@query("calibration_uniform", f"WITH {_UBIN} SELECT bin, n, {r6('mean_p')} AS mean_p, {r6('rate')} AS rate, {r6('abs(mean_p - rate)')} AS gap FROM b")
def calibration_uniform(t):
    return mt.calibration(view(t, "v_scores"), "score", "y", 10).select("bin", "n", *[rnd(c).alias(c) for c in ("mean_p", "rate", "gap")])


@query("calibration_decile", f"WITH {_QBIN}, b AS (SELECT bin, count(*) AS n, avg(score) AS mean_p, avg(y) AS rate FROM x GROUP BY 1) SELECT bin, n, {r6('mean_p')} AS mean_p, {r6('rate')} AS rate, {r6('abs(mean_p - rate)')} AS gap FROM b")
def calibration_decile(t):
    return mt.calibration(view(t, "v_scores"), "score", "y", 10, True).select("bin", "n", *[rnd(c).alias(c) for c in ("mean_p", "rate", "gap")])


@query("ece", f"WITH {_UBIN} SELECT {r6('sum(n * abs(mean_p - rate)) / sum(n)')} AS ece FROM b")
def ece(t):
    return mt.calibration(view(t, "v_scores"), "score", "y", 10).agg(rnd(F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


@query("ks_classifier", f"WITH {_ST} SELECT {r6('max(abs(cp / tp - (cn - cp) / (tn - tp)))')} AS ks FROM c")
def ks_classifier(t):
    return rk.ks_statistic(view(t, "v_scores")).select(rnd("ks").alias("ks"))


@query("decile_lift", f"""WITH {_QBIN}, b AS (SELECT bin, count(*) AS n, sum(y) AS pos FROM x GROUP BY 1) SELECT bin, n, {r6('(pos / n) / (sum(pos) OVER () / sum(n) OVER ())')} AS lift, {r6('sum(pos) OVER (ORDER BY bin DESC) / sum(pos) OVER ()')} AS capture FROM b""")
def decile_lift(t):
    b = quantile_bins(view(t, "v_scores").select("score", "y"), "score", 10, "bin")
    c = global_cumsum(b, "bin", {"n": F.lit(1).cast("bigint"), "pos": F.col("y").cast("bigint")}, descending=True)
    return c.select(F.col("bin").cast("int").alias("bin"), "n", rnd(F.col("pos") / F.col("n") / (F.col("tot_pos") / F.col("tot_n"))).alias("lift"), rnd(F.col("cum_pos") / F.col("tot_pos")).alias("capture"))


@query("precision_at_k", f"WITH k AS (SELECT y FROM v_scores ORDER BY score DESC, id LIMIT 500) SELECT {r6('avg(y)')} AS precision_at_500, {r6('sum(y) / (SELECT sum(y) FROM v_scores)')} AS recall_at_500 FROM k")
def precision_at_k(t):
    s = view(t, "v_scores").select("id", "score", "y")
    total = s.agg(F.sum("y")).scalar()
    return s.orderBy(F.desc("score"), "id").limit(500).agg(rnd(F.avg("y")).alias("precision_at_500"), rnd(F.sum("y") / total).alias("recall_at_500"))


@query("recall_at_k", "WITH k AS (SELECT g, CAST(sum(y) AS BIGINT) AS hits FROM (SELECT unnest([100, 500, 1000]) AS g) b, (SELECT y, row_number() OVER (ORDER BY score DESC, id) AS rn FROM v_scores) s WHERE rn <= g GROUP BY 1) " + f"SELECT CAST(g AS INT) AS k, hits, {r6('hits / (SELECT sum(y) FROM v_scores)')} AS recall FROM k")
def recall_at_k(t):
    """Recall at several budgets from one top-k pass (the largest budget bounds the rows)."""
    s = view(t, "v_scores").select("id", "score", "y")
    top = s.orderBy(F.desc("score"), "id").limit(1000).withColumn("one", F.lit(1))
    ranked = top.withColumn("rn", F.row_number().over(W.partitionBy("one").orderBy(F.desc("score"), "id")))
    hits = ranked.agg(*[F.sum(F.when(F.col("rn") <= k, F.col("y")).otherwise(0)).alias(f"h{k}") for k in (100, 500, 1000)]).withColumn("total", s.agg(F.sum("y")).scalar())
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in (100, 500, 1000)])
    return hits.select(F.inline(cells), "total").select("k", "hits", rnd(F.col("hits") / F.col("total")).alias("recall"))


GRID = [round(0.05 * i, 2) for i in range(1, 20)]
_GRID = ", ".join(f"({g}::DOUBLE)" for g in GRID)
_SW = f"""w AS (SELECT g AS threshold, sum(CAST(score >= g AS INT) * y)::DOUBLE AS tp, sum(CAST(score >= g AS INT) * (1 - y))::DOUBLE AS fp, sum(y)::DOUBLE AS p, count(*)::DOUBLE AS n FROM v_scores, (VALUES {_GRID}) v(g) GROUP BY 1)"""


@query("threshold_sweep", f"WITH {_SW} SELECT threshold, {r6('tp / (tp + fp)')} AS precision, {r6('tp / p')} AS recall, {r6('2 * tp / (tp + fp + p)')} AS f1, {r6('fp / (n - p)')} AS fpr, {r6('(tp + n - p - fp) / n')} AS accuracy FROM w")
def threshold_sweep(t):
    r = mt_rates(t)
    return r.select("threshold", *[rnd(c).alias(c) for c in ("precision", "recall", "f1", "fpr", "accuracy")])


def mt_rates(t, keys=()):
    return rk.confusion_rates(rk.threshold_grid(view(t, "v_scores"), GRID, keys=keys))


@query("threshold_cost", f"WITH {_SW}, c AS (SELECT threshold, 10 * (p - tp) + fp AS cost FROM w WHERE tp / p >= 0.5 AND 1 - fp / (n - p) >= 0.2) SELECT threshold, {r6('cost')} AS cost FROM c ORDER BY cost, threshold LIMIT 1")
def threshold_cost(t):
    r = mt_rates(t).filter((F.col("recall") >= 0.5) & (1 - F.col("fpr") >= 0.2))
    cost = 10 * (F.col("tot_pos") - F.col("cum_pos")) + F.col("cum_n") - F.col("cum_pos")
    return r.select("threshold", rnd(cost).alias("cost")).orderBy("cost", "threshold").limit(1)


@query("threshold_target", f"""WITH {_ST} SELECT {r6('min(CASE WHEN cp / cn >= .9 THEN score END)')} AS for_precision, {r6('max(CASE WHEN cp / tp >= .95 THEN score END)')} AS for_recall, {r6('(SELECT quantile_cont(score, .995) FROM v_scores WHERE y = 0)')} AS for_fpr FROM c""")
def threshold_target(t):
    s = view(t, "v_scores").select("score", "y")
    r = rk.with_rates(rk.score_table(s))
    cut = exact_quantiles(s.filter("y = 0"), "score", {"q": .995}).scalar()
    return r.agg(rnd(F.min(F.when(F.col("precision") >= .9, F.col("score")))).alias("for_precision"), rnd(F.max(F.when(F.col("recall") >= .95, F.col("score")))).alias("for_recall")).withColumn("for_fpr", rnd(cut))


@query("threshold_per_label", f"""WITH w AS (SELECT grp, g AS threshold, sum(CAST(score >= g AS INT) * y)::DOUBLE AS tp, sum(CAST(score >= g AS INT) * (1 - y))::DOUBLE AS fp, sum(y)::DOUBLE AS p FROM v_scores, (VALUES {_GRID}) v(g) GROUP BY 1, 2), f AS (SELECT *, 2 * tp / (tp + fp + p) AS f1 FROM w)
    SELECT grp, threshold, {r6('f1')} AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(f1, 9) DESC, threshold) AS rn FROM f) WHERE rn = 1""")
def threshold_per_label(t):
    best = F.max_by(F.struct("threshold", "f1"), F.struct(F.round("f1", 9), -F.col("threshold")))
    return mt_rates(t, ["grp"]).groupBy("grp").agg(best.alias("b")).select("grp", "b.threshold", rnd("b.f1").alias("f1"))


_ML = """x AS (SELECT doc_id, list_filter([CASE WHEN y = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN lang = 'fr' THEN 'fr' END], lambda v: v IS NOT NULL) AS tr,
    list_filter([CASE WHEN length(text) % 3 <> 0 THEN 'good' END, CASE WHEN doc_id % 4 = 0 THEN 'toxic' END, CASE WHEN lang IN ('fr', 'es') THEN 'fr' END], lambda v: v IS NOT NULL) AS pr FROM v_text),
    l AS (SELECT lab, sum(CAST(list_contains(tr, lab) AND list_contains(pr, lab) AS INT))::DOUBLE AS tp, sum(CAST(list_contains(pr, lab) AS INT))::DOUBLE AS called, sum(CAST(list_contains(tr, lab) AS INT))::DOUBLE AS sup FROM x, (VALUES ('good'), ('toxic'), ('fr')) v(lab) GROUP BY 1)"""


@query("multilabel_metrics", f"""WITH {_ML} SELECT {r6('2 * sum(tp) / (sum(called) + sum(sup))')} AS micro_f1, {r6('avg(2 * tp / (called + sup))')} AS macro_f1,
    (SELECT {r6('avg(CAST(list_sort(tr) = list_sort(pr) AS INT))')} FROM x) AS subset_accuracy, (SELECT {r6('avg(CAST(list_has_any(tr, pr) AS INT))')} FROM x) AS any_hit, (SELECT {r6('avg(len(pr))')} FROM x) AS cardinality FROM l""")
def multilabel_metrics(t):
    tag = lambda cond, name: F.when(cond, name)
    d = view(t, "v_text").select(
        F.array_compact(F.array(tag(F.col("y") == 1, "good"), tag(F.col("toxic") == 1, "toxic"), tag(F.col("lang") == "fr", "fr"))).alias("tr"),
        F.array_compact(F.array(tag(F.length("text") % 3 != 0, "good"), tag(F.col("doc_id") % 4 == 0, "toxic"), tag(F.col("lang").isin("fr", "es"), "fr"))).alias("pr"))
    both = d.select(F.explode(F.array_union("tr", "pr")).alias("lab"), "tr", "pr")
    per = both.groupBy("lab").agg(F.sum(flag(F.array_contains("tr", F.col("lab")) & F.array_contains("pr", F.col("lab")))).alias("tp"),
                                  F.sum(flag(F.array_contains("pr", F.col("lab")))).alias("called"), F.sum(flag(F.array_contains("tr", F.col("lab")))).alias("sup"))
    rows = d.agg(rnd(F.avg(flag(F.array_sort("tr") == F.array_sort("pr")))).alias("subset_accuracy"), rnd(F.avg(flag(F.arrays_overlap("tr", "pr")))).alias("any_hit"), rnd(F.avg(F.size("pr"))).alias("cardinality"))
    f1 = per.agg(rnd(2 * F.sum("tp") / (F.sum("called") + F.sum("sup"))).alias("micro_f1"), rnd(F.avg(2 * F.col("tp") / (F.col("called") + F.col("sup")))).alias("macro_f1"))
    return attach_one(f1, rows)


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("topk_accuracy", f"""WITH p AS (SELECT event_id, event_type, c.t, (event_id * (c.i + 3) * 7919) % 101 + CASE WHEN c.t = event_type THEN 30 ELSE 0 END AS p FROM events, (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(TYPES))}) c(i, t)),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY p DESC, t) AS rn FROM p) SELECT {', '.join(r6(f'avg(CAST(rn <= {k} AS INT))') + f' AS top_{k}' for k in (1, 2, 3))} FROM r WHERE t = event_type""")
def topk_accuracy(t):
    score = lambda i, c: (F.col("event_id") * (i + 3) * 7919) % 101 + F.when(F.col("event_type") == c, 30).otherwise(0)
    cells = F.array(*[F.struct(-score(i, c), F.lit(c).alias("t")) for i, c in enumerate(TYPES)])
    rank = F.array_position(F.transform(F.array_sort(cells), lambda x: x["t"]), F.col("event_type"))
    e = t.events.select(rank.alias("rank"))
    return e.agg(*[rnd(F.avg(flag(F.col("rank") <= k))).alias(f"top_{k}") for k in (1, 2, 3)])


@query("qwk", f"""WITH c AS (SELECT CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END AS a, CAST(least(floor(o_totalprice / 100000), 4) AS INT) AS p FROM orders),
    o AS (SELECT avg((a - p) ^ 2 / 16.0::DOUBLE) AS o FROM c), m AS (SELECT sum(na * np * (a - p) ^ 2 / 16.0::DOUBLE) / (SELECT count(*) FROM c) ^ 2 AS e FROM (SELECT a, count(*) AS na FROM c GROUP BY 1), (SELECT p, count(*) AS np FROM c GROUP BY 1))
    SELECT {r6('1 - o / e')} AS qwk FROM o, m""")
def qwk(t):
    ranks = F.create_map(*[F.lit(x) for kv in PRIORITY_RANK.items() for x in kv])
    c = t.orders.select((ranks[F.col("o_orderpriority")] - 1).alias("a"), F.least(F.floor(F.col("o_totalprice") / 100000), F.lit(4)).cast("int").alias("p"))
    return mt.kappa_quadratic(mt.confusion(c, "a", "p"), 5).select(rnd("qwk").alias("qwk"))


# ---- regression ----------------------------------------------------------------------------------

@query("regression_metrics", f"""SELECT {r6('avg((y_hat - y) ^ 2)', 1)} AS mse, {r6('sqrt(avg((y_hat - y) ^ 2))', 4)} AS rmse, {r6('avg(abs(y_hat - y))', 4)} AS mae, {r6('avg(y_hat - y)', 4)} AS bias,
    {r6('1 - sum((y_hat - y) ^ 2) / (var_pop(y) * count(*))')} AS r2, {r6('sqrt(avg((ln(1 + y_hat) - ln(1 + y)) ^ 2))')} AS rmsle FROM v_reg""")
def regression_metrics(t):
    digits = {"mse": 1, "rmse": 4, "mae": 4, "bias": 4, "r2": 6, "rmsle": 6}
    return view(t, "v_reg").agg(*[rnd(c, digits[n]).alias(n) for n, c in mt.regression_metrics("y", "y_hat").items()])


@query("pct_error_metrics", f"SELECT {r6('avg(abs(y_hat - y) / abs(y))')} AS mape, {r6('avg(2 * abs(y_hat - y) / (abs(y) + abs(y_hat)))')} AS smape, {r6('sum(abs(y_hat - y)) / sum(abs(y))')} AS wape, {r6('avg(CAST(abs(y_hat - y) / abs(y) <= 0.0455 AS INT))')} AS within FROM v_reg")
def pct_error_metrics(t):
    return view(t, "v_reg").agg(*[rnd(c).alias(n) for n, c in mt.percent_metrics("y", "y_hat", 0.0455).items()])


@query("mase", f"""WITH s AS (SELECT user_id, d, v, n * 40.0::DOUBLE AS p, lag(v) OVER (PARTITION BY user_id ORDER BY d) AS prev FROM v_day) SELECT user_id, {r6('avg(abs(v - p)) / nullif(avg(abs(v - prev)), 0)')} AS mase FROM s GROUP BY 1""")
def mase(t):
    s = view(t, "v_day").withColumn("day", F.unix_date("d"))
    s = over_rows(s, ["user_id"], "day", "day", lambda w: {"prev": F.lag("v").over(w)}, before=1)
    return s.groupBy("user_id").agg(rnd(ratio(F.avg(F.abs(F.col("v") - F.col("n") * 40.0)), F.avg(F.abs(F.col("v") - F.col("prev"))))).alias("mase"))


@query("pinball_loss", "SELECT " + ", ".join(r6(f"avg(greatest({q} * (y - y_hat), ({q} - 1) * (y - y_hat)))", 3) + f" AS q{int(q * 100)}" for q in (0.1, 0.5, 0.9)) + " FROM v_reg")
def pinball_loss(t):
    return view(t, "v_reg").agg(*[rnd(mt.pinball("y", F.col("y_hat"), q), 3).alias(f"q{int(q * 100)}") for q in (0.1, 0.5, 0.9)])


@query("interval_coverage", f"SELECT {r6('avg(CAST(y BETWEEN y_hat * 0.9455 AND y_hat * 1.0455 AS INT))')} AS coverage, {r6('avg(y_hat * 1.0455 - y_hat * 0.9455)', 3)} AS width FROM v_reg")
def interval_coverage(t):
    lo, hi = F.col("y_hat") * 0.9455, F.col("y_hat") * 1.0455
    return view(t, "v_reg").agg(rnd(F.avg(flag(F.col("y").between(lo, hi)))).alias("coverage"), rnd(F.avg(hi - lo), 3).alias("width"))


_Q3 = "(SELECT l_orderkey, l_linenumber, y_hat AS p50, x2 * x1 AS p90, y_hat * 1.05::DOUBLE AS p95 FROM v_reg)"


def quantile_forecasts(t):
    return view(t, "v_reg").select("l_orderkey", "l_linenumber", F.col("y_hat").alias("p50"), (F.col("x2") * F.col("x1")).alias("p90"), (F.col("y_hat") * 1.05).alias("p95"))


@query("quantile_crossing", f"SELECT CAST(sum(CAST(p50 > p90 AS INT)) AS BIGINT) AS p50_over_p90, CAST(sum(CAST(p90 > p95 AS INT)) AS BIGINT) AS p90_over_p95, {r6('avg(CAST(p50 > p90 OR p90 > p95 AS INT))')} AS share FROM {_Q3}")
def quantile_crossing(t):
    a, b = F.col("p50") > F.col("p90"), F.col("p90") > F.col("p95")
    return quantile_forecasts(t).agg(F.sum(flag(a)).alias("p50_over_p90"), F.sum(flag(b)).alias("p90_over_p95"), rnd(F.avg(flag(a | b))).alias("share"))


@query("quantile_sort", f"WITH q AS (SELECT *, list_sort([p50, p90, p95]) AS s FROM {_Q3}) SELECT l_orderkey, l_linenumber, {r6('s[1]', 3)} AS p50, {r6('s[2]', 3)} AS p90, {r6('s[3]', 3)} AS p95 FROM q")
def quantile_sort(t):
    s = F.array_sort(F.array("p50", "p90", "p95"))
    q = quantile_forecasts(t).withColumn("s", s)
    return q.select("l_orderkey", "l_linenumber", *[rnd(F.col("s")[i], 3).alias(n) for i, n in enumerate(("p50", "p90", "p95"))])


@query("conformal_offset", f"""WITH s AS (SELECT seg, abs(y - y_hat) AS e FROM v_reg), g AS (SELECT e, row_number() OVER (ORDER BY e) AS rn, count(*) OVER () AS n FROM s), o AS (SELECT max(e) AS e FROM g WHERE rn = least(ceil((n + 1) * 0.9), n)),
    k AS (SELECT seg, e, row_number() OVER (PARTITION BY seg ORDER BY e) AS rn, count(*) OVER (PARTITION BY seg) AS n FROM s)
    SELECT seg, n, {r6('CASE WHEN n >= 100 THEN k.e ELSE o.e END', 3)} AS "offset" FROM k, o WHERE rn = least(ceil((n + 1) * 0.9), n)""")
def conformal_offset(t):
    s = view(t, "v_reg").select("seg", F.abs(F.col("y") - F.col("y_hat")).alias("e"))
    return rk.split_conformal(s, "e", "seg", 0.1, 100).select("seg", "n", rnd("offset", 3).alias("offset"))


@query("asymmetric_loss", "SELECT " + ", ".join(r6(f"avg(CASE WHEN y > y_hat THEN {k} * (y - y_hat) ELSE y_hat - y END)", 3) + f" AS under_{k}" for k in (3, 4, 10)) + " FROM v_reg")
def asymmetric_loss(t):
    e = F.col("y") - F.col("y_hat")
    return view(t, "v_reg").agg(*[rnd(F.avg(F.when(e > 0, k * e).otherwise(-e)), 3).alias(f"under_{k}") for k in (3, 4, 10)])


@query("tweedie_deviance", f"SELECT {r6('2 * avg(y ^ 0.5::DOUBLE / (-0.5 * 0.5) - y * y_hat ^ (-0.5::DOUBLE) / (-0.5) + y_hat ^ 0.5::DOUBLE / 0.5)', 5)} AS deviance FROM v_reg")
def tweedie_deviance(t):
    y, m, p = F.col("y"), F.col("y_hat"), 1.5
    dev = F.pow(y, 2 - p) / ((1 - p) * (2 - p)) - y * F.pow(m, 1 - p) / (1 - p) + F.pow(m, 2 - p) / (2 - p)
    return view(t, "v_reg").agg(rnd(2 * F.avg(dev), 5).alias("deviance"))


@query("gini_lorenz", f"""WITH s AS (SELECT score, count(*) AS n, sum(amount * y) AS l FROM v_scores GROUP BY 1), c AS (SELECT *, sum(l) OVER (ORDER BY score) AS cl, sum(n) OVER () AS tn, sum(l) OVER () AS tl FROM s) SELECT {r6('1 - 2 * sum(n / tn * (2 * cl - l) / (2 * tl))')} AS gini FROM c""")
def gini_lorenz(t):
    return rk.gini_lorenz(view(t, "v_scores"), "score", F.col("amount") * F.col("y")).select(rnd("gini").alias("gini"))


@query("loss_ratio", f"WITH r AS (SELECT grp, sum(y * amount) / sum(amount) AS actual, sum(score * amount) / sum(amount) AS expected FROM v_scores GROUP BY 1) SELECT grp, {r6('actual')} AS actual, {r6('expected')} AS expected, {r6('abs(expected - actual) / actual')} AS ape FROM r")
def loss_ratio(t):
    w = lambda c: F.sum(F.col(c) * F.col("amount")) / F.sum("amount")
    r = view(t, "v_scores").groupBy("grp").agg(w("y").alias("actual"), w("score").alias("expected"))
    return r.select("grp", rnd("actual").alias("actual"), rnd("expected").alias("expected"), rnd(ratio(F.abs(F.col("expected") - F.col("actual")), "actual")).alias("ape"))


@query("rank_ic", f"""WITH p AS (SELECT a.user_id, a.d, h, a.v / a.n AS pred, b.v / b.n AS act FROM v_day a, (VALUES (1), (2), (3)) k(h) JOIN v_day b ON true WHERE b.user_id = a.user_id AND b.d = a.d + CAST(h AS INT)),
    r AS (SELECT h, d, rank() OVER (PARTITION BY h, d ORDER BY pred) + (count(*) OVER (PARTITION BY h, d, pred) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY h, d ORDER BY act) + (count(*) OVER (PARTITION BY h, d, act) - 1) / 2.0::DOUBLE AS rb FROM p),
    c AS (SELECT h, d, corr(ra, rb) AS ic FROM r GROUP BY 1, 2 HAVING count(*) > 2) SELECT CAST(h AS INT) AS h, count(*) AS days, {r6('avg(ic)', 5)} AS mean_ic FROM c GROUP BY 1""")
def rank_ic(t):
    v = view(t, "v_day").select("user_id", "d", (F.col("v") / F.col("n")).alias("x"))
    ahead = v.select("user_id", F.col("d").alias("d2"), F.col("x").alias("act"))
    p = v.withColumn("h", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)]))).withColumn("d2", F.date_add("d", F.col("h")))
    p = p.join(ahead, ["user_id", "d2"]).select("h", "d", F.col("x").alias("pred"), "act")
    ra = average_rank(p, "pred", ["h", "d"]).select("h", "d", "pred", F.col("avg_rank").alias("ra"))
    rb = average_rank(p, "act", ["h", "d"]).select("h", "d", "act", F.col("avg_rank").alias("rb"))
    c = p.join(ra, ["h", "d", "pred"]).join(rb, ["h", "d", "act"]).groupBy("h", "d").agg(F.corr("ra", "rb").alias("ic"), F.count(F.lit(1)).alias("n")).filter("n > 2")
    return c.groupBy("h").agg(F.count(F.lit(1)).alias("days"), rnd(F.avg("ic"), 5).alias("mean_ic"))


@query("ats_rate", f"SELECT {r6('avg(CAST((y_hat > x1 * x2 AND y > x1 * x2) OR (y_hat < x1 * x2 AND y < x1 * x2) AS INT))')} AS win_rate FROM v_reg")
def ats_rate(t):
    line, p, y = F.col("x1") * F.col("x2"), F.col("y_hat"), F.col("y")
    return view(t, "v_reg").agg(rnd(F.avg(flag(((p > line) & (y > line)) | ((p < line) & (y < line))))).alias("win_rate"))


@query("residual_table", f"""WITH r AS (SELECT l_orderkey, l_linenumber, y - y_hat AS e, (y - y_hat) / y AS pct FROM v_reg), q AS (SELECT quantile_cont(e, .05) AS lo, quantile_cont(e, .95) AS hi FROM r)
    SELECT l_orderkey, l_linenumber, {r6('e', 3)} AS residual, {r6('pct')} AS pct, CAST(e < lo OR e > hi AS INT) AS extreme FROM r, q""")
def residual_table(t):
    r = view(t, "v_reg").select("l_orderkey", "l_linenumber", (F.col("y") - F.col("y_hat")).alias("e"), "y")
    r = attach_one(r, exact_quantiles(r, "e", {"lo": .05, "hi": .95}))
    return r.select("l_orderkey", "l_linenumber", rnd("e", 3).alias("residual"), rnd(ratio("e", "y")).alias("pct"), flag((F.col("e") < F.col("lo")) | (F.col("e") > F.col("hi"))).alias("extreme"))


@query("segment_metrics", f"SELECT seg, count(*) AS n, {r6('sqrt(avg((y_hat - y) ^ 2))', 4)} AS rmse, {r6('avg(abs(y_hat - y))', 4)} AS mae, {r6('avg(abs(y_hat - y) / y)')} AS mape FROM v_reg GROUP BY 1")
def segment_metrics(t):
    m, p = mt.regression_metrics("y", "y_hat"), mt.percent_metrics("y", "y_hat", .1)
    return view(t, "v_reg").groupBy("seg").agg(F.count(F.lit(1)).alias("n"), rnd(m["rmse"], 4).alias("rmse"), rnd(m["mae"], 4).alias("mae"), rnd(p["mape"]).alias("mape"))


# ---- survival ------------------------------------------------------------------------------------

_KM = """r AS (SELECT grp, duration, sum(event) AS d, count(*) AS n FROM v_surv GROUP BY 1, 2), k AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY duration DESC) AS at_risk FROM r),
    s AS (SELECT *, exp(sum(CASE WHEN d >= at_risk THEN 0 ELSE ln(1 - d / at_risk) END) OVER w) * CASE WHEN sum(CAST(d >= at_risk AS INT)) OVER w > 0 THEN 0 ELSE 1 END AS surv FROM k WINDOW w AS (PARTITION BY grp ORDER BY duration))"""


@query("km_curve", f"WITH {_KM} SELECT grp, duration, CAST(at_risk AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, {r6('surv')} AS survival FROM s")
def km_curve(t):
    return sv.kaplan_meier(view(t, "v_surv"), "duration", "event", ["grp"]).select("grp", F.col("duration").cast("int").alias("duration"), "at_risk", "events", rnd("survival").alias("survival"))


@query("concordance_index", f"""SELECT count(*) AS comparable, CAST(sum(CAST(a.risk > b.risk AS INT)) AS BIGINT) AS concordant, CAST(sum(CAST(a.risk = b.risk AS INT)) AS BIGINT) AS tied,
    {r6('(sum(CAST(a.risk > b.risk AS INT)) + 0.5::DOUBLE * sum(CAST(a.risk = b.risk AS INT))) / count(*)')} AS c_index FROM v_surv a JOIN v_surv b ON a.event = 1 AND a.duration < b.duration""")
def concordance_index(t):
    return sv.concordance(view(t, "v_surv"), "duration", "event", "risk").select("comparable", "concordant", "tied", rnd("c_index").alias("c_index"))


@query("survival_brier", f"SELECT {r6('avg(((1 - risk) - CAST(duration > 12 AS INT)) ^ 2)')} AS brier_12, count(*) AS n FROM v_surv WHERE duration > 12 OR event = 1")
def survival_brier(t):
    s = view(t, "v_surv").filter("duration > 12 OR event = 1")
    return s.agg(rnd(F.avg(F.pow((1 - F.col("risk")) - flag(F.col("duration") > 12), 2))).alias("brier_12"), F.count(F.lit(1)).alias("n"))


@query("expected_lifetime", f"""WITH {_KM}, p AS (SELECT grp, duration, surv, lag(duration, 1, 0) OVER w AS t0, lag(surv, 1, 1.0::DOUBLE) OVER w AS s0 FROM s WINDOW w AS (PARTITION BY grp ORDER BY duration)) SELECT grp, {r6('sum((duration - t0) * (surv + s0) / 2)')} AS months, {r6('sum((duration - t0) * (surv + s0) / 2) * 99')} AS revenue FROM p GROUP BY 1""")
def expected_lifetime(t):
    k = sv.kaplan_meier(view(t, "v_surv"), "duration", "event", ["grp"])
    k = over_rows(k, ["grp"], "duration", "duration", lambda w: {"t0": F.lag("duration", 1, 0.0).over(w), "s0": F.lag("survival", 1, 1.0).over(w)}, before=1)
    months = F.sum((F.col("duration") - F.col("t0")) * (F.col("survival") + F.col("s0")) / 2)
    return k.groupBy("grp").agg(rnd(months).alias("months"), rnd(months * 99).alias("revenue"))


# ---- uplift --------------------------------------------------------------------------------------

_ATE = "avg(CASE WHEN treatment = 1 THEN y END) - avg(CASE WHEN treatment = 0 THEN y END)"


def ate():
    side = lambda v: F.avg(F.when(F.col("treatment") == v, F.col("y")))
    return side(1) - side(0)


@query("ate_by_segment", f"SELECT coalesce(grp, 'ALL') AS grp, {r6(_ATE)} AS ate, count(*) AS n FROM v_scores GROUP BY GROUPING SETS ((grp), ())")
def ate_by_segment(t):
    return view(t, "v_scores").rollup("grp").agg(rnd(ate()).alias("ate"), F.count(F.lit(1)).alias("n")).select(F.coalesce("grp", F.lit("ALL")).alias("grp"), "ate", "n")


@query("uplift_decile", f"WITH {_QBIN} SELECT bin, count(*) AS n, {r6('avg(score)')} AS mean_score, {r6(_ATE)} AS ate FROM x GROUP BY 1")
def uplift_decile(t):
    b = quantile_bins(view(t, "v_scores").select("score", "y", "treatment"), "score", 10, "bin")
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("score")).alias("mean_score"), rnd(ate()).alias("ate"))


@query("qini_auuc", f"""WITH s AS (SELECT score, count(*) AS n, sum(treatment) AS nt, sum(treatment * y) AS yt, sum((1 - treatment) * y) AS yc FROM v_scores GROUP BY 1),
    c AS (SELECT n, sum(n) OVER w AS cn, sum(nt) OVER w AS cnt, sum(yt) OVER w AS cyt, sum(yc) OVER w AS cyc, sum(n) OVER () AS tn, score FROM s WINDOW w AS (ORDER BY score DESC)), q AS (SELECT *, cyt - coalesce(cyc * cnt / nullif(cn - cnt, 0), 0) AS q FROM c)
    SELECT {r6('sum(n / tn * (q + p) / 2)', 4)} AS auuc, {r6('max(q)', 4)} AS best FROM (SELECT *, lag(q, 1, 0.0::DOUBLE) OVER (ORDER BY score DESC) AS p FROM q)""")
def qini_auuc(t):
    s = rk.qini_points(view(t, "v_scores"), "score", "treatment", "y")
    return s.agg(rnd(F.sum(F.col("_w") * (F.col("qini") + F.col("_prev")) / 2), 4).alias("auuc"), rnd(F.max("qini"), 4).alias("best"))


# ---- fairness ------------------------------------------------------------------------------------

@query("fairness_audit", f"""WITH a AS (SELECT grp, y, score, {_HIT} AS p, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0::DOUBLE AS r FROM v_scores)
    SELECT grp, count(*) AS n, {r6('avg(p)')} AS flagged, {r6('avg(y)')} AS rate, {r6('sum(y * p) / sum(p)')} AS precision, {r6('sum(y * p) / sum(y)')} AS recall, {r6('sum((1 - y) * p) / sum(1 - y)')} AS fpr, {r6('sum(y * (1 - p)) / sum(y)')} AS fnr,
    {r6('avg((score - y) ^ 2)')} AS brier, {r6(_AUC)} AS auc FROM a GROUP BY 1 HAVING count(*) >= 100""")
def fairness_audit(t):
    s = scored(t)
    g = s.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *[rnd(c).alias(n) for n, c in mt.binary_rates("y", "pred").items()], rnd(F.avg(F.pow(F.col("score") - F.col("y"), 2))).alias("brier"))
    return g.filter("n >= 100").join(rk.roc_auc(s, keys=["grp"]).select("grp", rnd("auc").alias("auc")), "grp")


@query("disparate_impact", f"WITH r AS (SELECT grp, avg({_HIT}) AS rate FROM v_scores GROUP BY 1) SELECT grp, {r6('rate')} AS rate, {r6('rate / (SELECT rate FROM r WHERE grp = ' + chr(39) + '1-URGENT' + chr(39) + ')')} AS impact, CAST(rate / (SELECT rate FROM r WHERE grp = '1-URGENT') < 0.8 AS INT) AS alarm FROM r")
def disparate_impact(t):
    r = scored(t).groupBy("grp").agg(F.avg("pred").alias("rate"))
    impact = F.col("rate") / r.filter("grp = '1-URGENT'").select("rate").scalar()
    return r.select("grp", rnd("rate").alias("rate"), rnd(impact).alias("impact"), flag(impact < 0.8).alias("alarm"))


@query("sens_at_spec", f"WITH c AS (SELECT grp, quantile_cont(score, .9) AS cut FROM v_scores WHERE y = 0 GROUP BY 1) SELECT grp, {r6('cut')} AS cut, {r6('avg(CAST(score >= cut AS INT))')} AS sensitivity FROM v_scores JOIN c USING (grp) WHERE y = 1 GROUP BY 1, cut")
def sens_at_spec(t):
    s = view(t, "v_scores").select("grp", "score", "y")
    c = exact_quantiles(s.filter("y = 0"), "score", {"cut": .9}, ["grp"])
    return s.filter("y = 1").join(c, "grp").groupBy("grp").agg(rnd(F.max("cut")).alias("cut"), rnd(F.avg(flag(F.col("score") >= F.col("cut")))).alias("sensitivity"))


@query("group_thresholds", f"WITH c AS (SELECT grp, quantile_cont(score, .7) AS cut FROM v_scores GROUP BY 1) SELECT grp, {r6('cut')} AS cut, {r6('avg(CAST(score >= cut AS INT))')} AS approval FROM v_scores JOIN c USING (grp) GROUP BY 1, cut")
def group_thresholds(t):
    s = view(t, "v_scores").select("grp", "score")
    return s.join(exact_quantiles(s, "score", {"cut": .7}, ["grp"]), "grp").groupBy("grp").agg(rnd(F.max("cut")).alias("cut"), rnd(F.avg(flag(F.col("score") >= F.col("cut")))).alias("approval"))


# ---- baselines and the rest ----------------------------------------------------------------------

@query("baseline_models", f"""WITH {_HOURLY}, f AS (SELECT n, lag(n) OVER (PARTITION BY event_type ORDER BY hr) AS naive, lag(n, 168) OVER (PARTITION BY event_type ORDER BY hr) AS seasonal, avg(n) OVER (PARTITION BY event_type ORDER BY hr ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS moving FROM p)
    SELECT {r6('avg(abs(n - naive))')} AS naive, {r6('avg(abs(n - seasonal))')} AS seasonal, {r6('avg(abs(n - moving))')} AS moving, {r6('avg(abs(n - (SELECT avg(n) FROM p)))')} AS mean, (SELECT {r6('greatest(avg(y), 1 - avg(y))')} FROM v_scores) AS majority_accuracy FROM f""")
def baseline_models(t):
    def feats(w):
        return {"naive": F.lag("n").over(w), "seasonal": F.lag("n", 168).over(w), "moving": F.avg("n").over(w.rowsBetween(-24, -1))}
    p = hourly(t)
    f = over_rows(p, ["event_type"], "hr", "hr", feats, before=168)
    err = lambda c: rnd(F.avg(F.abs(F.col("n") - c)))
    major = view(t, "v_scores").agg(F.greatest(F.avg("y"), 1 - F.avg("y"))).scalar()
    f = f.withColumn("m", p.agg(F.avg("n")).scalar())
    return f.agg(*[err(F.col(c)).alias(c) for c in ("naive", "seasonal", "moving")], err(F.col("m")).alias("mean")).withColumn("majority_accuracy", rnd(major))


@query("threshold_row_cost", f"""WITH s AS (SELECT score, count(*) AS n, sum(y) AS pos, sum(y * amount) AS miss FROM v_scores GROUP BY 1), c AS (SELECT score, 50000 * (sum(n) OVER w - sum(pos) OVER w) + sum(miss) OVER () - sum(miss) OVER w AS cost FROM s WINDOW w AS (ORDER BY score DESC))
    SELECT {r6('score')} AS threshold, {r6('cost', 2)} AS cost FROM c ORDER BY cost, score LIMIT 1""")
def threshold_row_cost(t):
    """A false alarm costs a fixed 50000, a miss costs the row's amount."""
    s = rk.score_table(view(t, "v_scores"), extra={"miss": F.col("y") * F.col("amount")})
    cost = 50000 * (F.col("cum_n") - F.col("cum_pos")) + F.col("tot_miss") - F.col("cum_miss")
    return s.select("score", cost.alias("c")).orderBy("c", "score").limit(1).select(rnd("score").alias("threshold"), rnd("c", 2).alias("cost"))


@query("var_exceptions", """WITH d AS (SELECT event_type, (epoch_us(ts) // 604800000000) AS wk, 30 - value AS ret FROM events), q AS (SELECT event_type, quantile_cont(ret, .05) AS q FROM d GROUP BY 1) SELECT event_type, CAST(wk AS BIGINT) AS wk, CAST(sum(CAST(ret < q AS INT)) AS BIGINT) AS exceptions FROM d JOIN q USING (event_type) GROUP BY 1, 2""")
def var_exceptions(t):
    d = events(t).select("event_type", F.floor(F.col("clock") / (7 * DAY_US)).alias("wk"), (30 - F.col("value")).alias("ret"))
    return d.join(exact_quantiles(d, "ret", {"q": .05}, ["event_type"]), "event_type").groupBy("event_type", "wk").agg(F.sum(flag(F.col("ret") < F.col("q"))).alias("exceptions"))


@query("service_level", f"SELECT user_id, {r6('avg(CAST(v <= 150 AS INT))')} AS service_level, {r6('sum(greatest(v - 150, 0)) * 5')} AS stockout_cost, {r6('sum(greatest(150 - v, 0)) * 0.1')} AS holding_cost FROM v_day GROUP BY 1")
def service_level(t):
    v = F.col("v")
    return view(t, "v_day").groupBy("user_id").agg(rnd(F.avg(flag(v <= 150))).alias("service_level"), rnd(F.sum(F.greatest(v - 150, F.lit(0.0))) * 5).alias("stockout_cost"), rnd(F.sum(F.greatest(150 - v, F.lit(0.0))) * 0.1).alias("holding_cost"))


def _agreement_sql(rows):
    return f"""WITH r AS ({rows}), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM r GROUP BY 1, 2), x AS (SELECT sum(n) AS n FROM c GROUP BY a), y AS (SELECT sum(n) AS n FROM c GROUP BY b), t AS (SELECT sum(n) AS n FROM c),
    s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS pc, (SELECT sum(n * (n - 1) / 2) FROM x) AS px, (SELECT sum(n * (n - 1) / 2) FROM y) AS py, (SELECT -sum(n / t.n * ln(n / t.n)) FROM (SELECT n AS n FROM c) k(n), t) AS hc,
      (SELECT -sum(k.n / t.n * ln(k.n / t.n)) FROM x k, t) AS hx, (SELECT -sum(k.n / t.n * ln(k.n / t.n)) FROM y k, t) AS hy, (SELECT -sum(k.n / t.n * ln(k.n / t.n)) FROM c k, t) AS hxy, n FROM t)"""


_AR = f"{r6('(pc - px * py / (n * (n - 1) / 2)) / ((px + py) / 2 - px * py / (n * (n - 1) / 2))')} AS ari"
_NM = f"{r6('(hx + hy - hxy) / ((hx + hy) / 2)')} AS nmi"
_LABELS = "SELECT label AS a, CAST(embedding[1] > 0 AS INT) * 2 + CAST(embedding[2] > 0 AS INT) AS b FROM embeddings"


def _fix(sql):
    return sql.replace("(SELECT -sum(n / t.n * ln(n / t.n)) FROM (SELECT n AS n FROM c) k(n), t) AS hc,", "")


def labelings(t):
    e = F.col("embedding")
    return t.embeddings.select(F.col("label").alias("a"), (flag(e[0] > 0) * 2 + flag(e[1] > 0)).alias("b"))


@query("ari", _fix(f"{_agreement_sql(_LABELS)} SELECT {_AR} FROM s"))
def ari(t):
    return mt.pair_agreement(labelings(t), "a", "b").select(rnd("ari").alias("ari"))


@query("nmi", _fix(f"{_agreement_sql(_LABELS)} SELECT {_NM} FROM s"))
def nmi(t):
    return mt.pair_agreement(labelings(t), "a", "b").select(rnd("nmi").alias("nmi"))


@query("cluster_stability", _fix(_agreement_sql("SELECT CAST(p.v > 60 AS INT) + CAST(p.v > 100 AS INT) AS a, CAST(q.v > 60 AS INT) + CAST(q.v > 100 AS INT) AS b FROM (SELECT user_id, avg(v) AS v FROM v_day WHERE d < DATE '2024-01-15' GROUP BY 1) p JOIN (SELECT user_id, avg(v) AS v FROM v_day WHERE d >= DATE '2024-01-15' GROUP BY 1) q USING (user_id)") + f" SELECT {_AR}, {_NM} FROM s"))
def cluster_stability(t):
    v, cut = view(t, "v_day"), F.lit("2024-01-15").cast("date")
    seg = flag(F.col("m") > 60) + flag(F.col("m") > 100)
    half = lambda cond, name: v.filter(cond).groupBy("user_id").agg(F.avg("v").alias("m")).select("user_id", seg.alias(name))
    both = half(F.col("d") < cut, "a").join(half(F.col("d") >= cut, "b"), "user_id")
    return mt.pair_agreement(both, "a", "b").select(rnd("ari").alias("ari"), rnd("nmi").alias("nmi"))


@query("effect_size_ci", f"""WITH g AS (SELECT avg(amount) FILTER (treatment = 1) AS m1, avg(amount) FILTER (treatment = 0) AS m0, var_samp(amount) FILTER (treatment = 1) AS v1, var_samp(amount) FILTER (treatment = 0) AS v0, count(*) FILTER (treatment = 1) AS n1, count(*) FILTER (treatment = 0) AS n0 FROM v_scores)
    SELECT {r6('m1 - m0', 2)} AS diff, {r6('(m1 - m0) / sqrt((v1 + v0) / 2)')} AS effect, {r6('m1 - m0 - 1.96 * sqrt(v1 / n1 + v0 / n0)', 2)} AS low, {r6('m1 - m0 + 1.96 * sqrt(v1 / n1 + v0 / n0)', 2)} AS high FROM g""")
def effect_size_ci(t):
    arm = lambda v: F.when(F.col("treatment") == v, F.col("amount"))
    s = view(t, "v_scores").agg(*[f(arm(v)).alias(f"{n}{v}") for v in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    diff, half = F.col("m1") - F.col("m0"), 1.96 * F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))
    return s.select(rnd(diff, 2).alias("diff"), rnd(diff / F.sqrt((F.col("v1") + F.col("v0")) / 2)).alias("effect"), rnd(diff - half, 2).alias("low"), rnd(diff + half, 2).alias("high"))
