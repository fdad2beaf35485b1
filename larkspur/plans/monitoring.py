"""Monitoring, explanation and decision rules."""

from pyspark.sql import Window as W, functions as F

from larkspur.functions.scalar import flag, ladder, mix_hash, ratio, rnd
from larkspur.metrics import drift as dr, ranking as rk
from larkspur.operators import encode as en
from larkspur.operators.clean import attach_one
from larkspur.operators.prefix import exact_quantiles
from larkspur.operators.windows import group_values, over_rows, over_time, running
from larkspur.models.gram import pooled_segments, predict_segments
from larkspur.plans.registry import mix, query, r6
from larkspur.plans.series import DAY_US, events
from larkspur.plans.views import view

CUT = "2024-01-16"


def halves(t, *cols):
    e = t.events.select("ts", *cols)
    cut = F.lit(CUT).cast("timestamp_ntz")
    return e.filter(F.col("ts") < cut).drop("ts"), e.filter(F.col("ts") >= cut).drop("ts")


@query("promo_first", "SELECT event_id, CAST(event_type = 'purchase' AND sum(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS INT) AS first_promo FROM events")
def promo_first(t):
    promo = F.col("event_type") == "purchase"
    e = running(events(t), ["user_id"], "clock", "event_id", {"seen": ("sum", flag(promo))})
    return e.select("event_id", flag(promo & (F.col("seen") == 1)).alias("first_promo"))


_PSI = f"""r AS (SELECT value FROM events WHERE ts < TIMESTAMP '{CUT}'), c AS (SELECT value FROM events WHERE ts >= TIMESTAMP '{CUT}'), e AS (SELECT min(value) AS lo, max(value) AS hi FROM r),
    b AS (SELECT unnest(range(0, 10)) AS b), h AS (SELECT b.b, greatest((SELECT count(*) FROM r, e WHERE least(floor((value - lo) * 10 / (hi - lo)), 9) = b.b) / (SELECT count(*) FROM r), 1e-4::DOUBLE) AS p,
      greatest((SELECT count(*) FROM c, e WHERE value BETWEEN lo AND hi AND least(floor((value - lo) * 10 / (hi - lo)), 9) = b.b) / (SELECT count(*) FROM c), 1e-4::DOUBLE) AS q FROM b)"""


@query("psi", f"WITH {_PSI}, s AS (SELECT sum((q - p) * ln(q / p)) AS psi FROM h) SELECT {r6('psi', 8)} AS psi, CASE WHEN psi >= .25 THEN 'major' WHEN psi >= .1 THEN 'moderate' ELSE 'stable' END AS level FROM s")
def psi(t):
    old, new = halves(t, "value")
    return dr.psi(old, new, "value").select(rnd("psi", 8).alias("psi"), dr.psi_level(F.col("psi")).alias("level"))


@query("ks_two_sample", f"""WITH v AS (SELECT value, CAST(ts < TIMESTAMP '{CUT}' AS INT) AS a FROM events), s AS (SELECT value, sum(a) AS a, sum(1 - a) AS b FROM v GROUP BY 1), c AS (SELECT sum(a) OVER (ORDER BY value) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY value) / sum(b) OVER () AS fb FROM s) SELECT {r6('max(abs(fa - fb))')} AS d FROM c""")
def ks_two_sample(t):
    old, new = halves(t, "value")
    return rk.ks_two_sample(old, new, "value").select(rnd("d").alias("d"))


@query("ks_two_sample_p")
def ks_two_sample_p(t):
    old, new = halves(t, "value")
    return rk.ks_two_sample(old, new, "value").select(rnd("d").alias("d"), rnd("p_value").alias("p_value"))


@query("confidence_drop", f"WITH m AS (SELECT avg(abs(score - .5)) FILTER (id % 2 = 0) AS old, avg(abs(score * .9 - .5)) FILTER (id % 2 = 1) AS new FROM v_scores) SELECT {r6('old - new')} AS drop, CAST(old - new > .02 AS INT) AS alert FROM m")
def confidence_drop(t):
    even = F.col("id") % 2 == 0
    m = view(t, "v_scores").agg((F.avg(F.when(even, F.abs(F.col("score") - .5))) - F.avg(F.when(~even, F.abs(F.col("score") * .9 - .5)))).alias("d"))
    return m.select(rnd("d").alias("drop"), flag(F.col("d") > .02).alias("alert"))


@query("prediction_drift", f"""WITH d AS (SELECT seg, day, count(*) AS n, sum(e) AS s, sum(e * e) AS q, sum(ape) AS a FROM (SELECT l.l_returnflag AS seg, date_diff('day', DATE '1970-01-01', CAST(l.l_shipdate AS DATE)) AS day, r.y_hat - r.y AS e, abs(r.y_hat - r.y) / r.y AS ape FROM v_reg r JOIN lineitem l ON r.l_orderkey = l.l_orderkey AND r.l_linenumber = l.l_linenumber AND r.y = l.l_extendedprice AND r.x1 = l.l_quantity) GROUP BY 1, 2),
    w AS (SELECT seg, day, sum(n) OVER f AS n, sum(s) OVER f AS s, sum(q) OVER f AS q, sum(a) OVER f AS a FROM d WINDOW f AS (PARTITION BY seg ORDER BY day RANGE BETWEEN 29 PRECEDING AND CURRENT ROW))
    SELECT seg, CAST(day AS INT) AS day, CAST(n AS BIGINT) AS n, {r6('s / n', 3)} AS bias, {r6('CASE WHEN n > 1 THEN (q - s * s / n) / (n - 1) END / 1000', 2)} AS variance_k, {r6('a / n')} AS mape, CASE WHEN abs(s / n) > 100 THEN 'retrain' ELSE 'ok' END AS level FROM w""")
def prediction_drift(t):
    """Rolling 30-day bias, variance and MAPE from daily sums: the window runs over days, never over rows."""
    r = view(t, "v_reg").drop("seg")
    li = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("seg"), F.unix_date(F.to_date("l_shipdate")).alias("day"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x1"))
    j = r.join(li, ["l_orderkey", "l_linenumber", "y", "x1"])
    e = F.col("y_hat") - F.col("y")
    d = j.groupBy("seg", "day").agg(F.count(F.lit(1)).alias("n1"), F.sum(e).alias("s1"), F.sum(e * e).alias("q1"), F.sum(F.abs(e) / F.col("y")).alias("a1"))
    w = over_time(d, ["seg"], "day", 30, lambda w: {c: F.sum(f"{c}1").over(w.rangeBetween(-29, 0)) for c in "nsqa"})
    n = F.col("n")
    var = F.when(n > 1, (F.col("q") - F.col("s") * F.col("s") / n) / F.nullif(n - 1, F.lit(0)))
    return w.select("seg", "day", "n", rnd(F.col("s") / n, 3).alias("bias"), rnd(var / 1000, 2).alias("variance_k"), rnd(F.col("a") / n).alias("mape"),
                    F.when(F.abs(F.col("s") / n) > 100, "retrain").otherwise("ok").alias("level"))


@query("mi_stability", f"""WITH b AS (SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS INT) AS wk, CAST(value > 20 AS INT) AS y FROM events), j AS (SELECT wk, event_type AS x, y, count(*)::DOUBLE AS n FROM b GROUP BY 1, 2, 3),
    k AS (SELECT wk, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY wk, x) AS nx, sum(n) OVER (PARTITION BY wk, y) AS ny, sum(n) OVER (PARTITION BY wk) AS t FROM j) GROUP BY 1)
    SELECT wk, {r6('mi', 8)} AS mi, {r6('mi - lag(mi) OVER (ORDER BY wk)', 8)} AS change, CAST(coalesce(mi < .5 * lag(mi) OVER (ORDER BY wk), false) AS INT) AS alert FROM k""")
def mi_stability(t):
    b = t.events.select("event_type", F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7).cast("int").alias("wk"), flag(F.col("value") > 20).alias("y"))
    m = en.mutual_info(b, ["event_type"], "y", ["wk"])
    past = F.lag("mi").over(W.partitionBy("feature").orderBy("wk"))
    return m.select("wk", rnd("mi", 8).alias("mi"), rnd(F.col("mi") - past, 8).alias("change"), flag(F.col("mi") < .5 * past).alias("alert"))


@query("feature_freshness", f"SELECT user_id, {r6('((SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts))) / 1000000.0::DOUBLE', 3)} AS age_s, CAST((SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts)) > 60000000 AS INT) AS stale FROM events GROUP BY 1")
def feature_freshness(t, now=None):
    """Age of each user's newest event at the instant ``now`` (microseconds; by default the newest event of all)."""
    e = events(t)
    now = e.agg(F.max("clock")).scalar() if now is None else F.lit(now)
    age = now - F.max("clock")
    return e.groupBy("user_id").agg(rnd(age / F.lit(1e6), 3).alias("age_s"), flag(age > 60_000_000).alias("stale"))


@query("randomization_check", " UNION ALL ".join(f"SELECT '{c}' AS feature, {r6(f'(avg({c}) FILTER (treatment = 1) - avg({c}) FILTER (treatment = 0)) / sqrt((var_samp({c}) FILTER (treatment = 1) + var_samp({c}) FILTER (treatment = 0)) / 2)')} AS smd FROM v_scores" for c in ("score", "amount", "y")))
def randomization_check(t):
    def smd(c):
        arm = lambda v: F.when(F.col("treatment") == v, F.col(c))
        return (F.avg(arm(1)) - F.avg(arm(0))) / F.sqrt((F.var_samp(arm(1)) + F.var_samp(arm(0))) / 2)
    cols = ("score", "amount", "y")
    s = view(t, "v_scores").agg(*[rnd(smd(c)).alias(c) for c in cols])
    return s.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("smd")) for c in cols])))


@query("live_dashboard", f"""SELECT CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS hour_start, count(*) AS throughput, {r6('quantile_cont(value, .99)')} AS p99, {r6('quantile_cont(value, .5)')} AS median, {r6("avg(CAST(event_type = 'purchase' AS INT))")} AS decision_rate FROM events GROUP BY 1""")
def live_dashboard(t):
    hour = F.unix_micros(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    e = t.events.select(hour.alias("hour_start"), "value", "event_type")
    s = e.groupBy("hour_start").agg(F.count(F.lit(1)).alias("throughput"), rnd(F.avg(flag(F.col("event_type") == "purchase"))).alias("decision_rate"))
    q = exact_quantiles(e, "value", {"p99": .99, "median": .5}, ["hour_start"])
    return s.join(q, "hour_start").select("hour_start", "throughput", rnd("p99").alias("p99"), rnd("median").alias("median"), "decision_rate")


# fixed linear model of the explanation and scoring queries
WEIGHTS = {"l_quantity": 0.8, "l_discount": -12.0, "l_tax": 5.0, "l_extendedprice": 0.0002}
REASONS = {"l_quantity": "R01", "l_discount": "R02", "l_tax": "R03", "l_extendedprice": "R04"}


def _contrib_sql():
    parts = " UNION ALL ".join(f"SELECT rid, l_orderkey, l_linenumber, '{c}' AS feature, {w} * ({c} - (SELECT avg({c}) FROM lineitem)) AS v FROM b" for c, w in WEIGHTS.items())
    return f"b AS (SELECT row_number() OVER () AS rid, * FROM lineitem), c AS ({parts}), r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY round(abs(v), 9) DESC, feature) AS rn FROM c)"


def contributions(df, weights):
    """Sorted w * (x - mean) cells of each row, strongest first; the means are one scalar row."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in weights])
    rows = attach_one(df, means)
    cells = F.array(*[F.struct(-F.round(F.abs(w * (F.col(c) - F.col(f"_m_{c}"))), 9), F.lit(c).alias("feature"), (w * (F.col(c) - F.col(f"_m_{c}"))).alias("v")) for c, w in weights.items()])
    return rows.withColumn("cells", F.array_sort(cells)).drop(*means.columns)


@query("linear_contrib", f"WITH {_contrib_sql()} SELECT l_orderkey, l_linenumber, {r6('sum(v)', 5)} AS total, {r6('max(CASE WHEN rn = 1 THEN v END)', 5)} AS top1, {r6('max(CASE WHEN rn = 2 THEN v END)', 5)} AS top2 FROM r GROUP BY l_orderkey, l_linenumber, rid")
def linear_contrib(t):
    c = contributions(t.lineitem.select("l_orderkey", "l_linenumber", *WEIGHTS), WEIGHTS)
    total = F.aggregate("cells", F.lit(0.0), lambda a, x: a + x["v"])
    return c.select("l_orderkey", "l_linenumber", rnd(total, 5).alias("total"), rnd(F.col("cells")[0]["v"], 5).alias("top1"), rnd(F.col("cells")[1]["v"], 5).alias("top2"))


@query("reason_codes", f"WITH {_contrib_sql()} SELECT l_orderkey, l_linenumber, CAST(rn AS INT) AS pos, CASE feature " + " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in REASONS.items()) + " END AS reason FROM r WHERE rn <= 3")
def reason_codes(t):
    c = contributions(t.lineitem.select("l_orderkey", "l_linenumber", *WEIGHTS), WEIGHTS)
    codes = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    top = c.select("l_orderkey", "l_linenumber", F.posexplode(F.slice("cells", 1, 3)).alias("pos", "cell"))
    return top.select("l_orderkey", "l_linenumber", (F.col("pos") + 1).alias("pos"), codes[F.col("cell.feature")].alias("reason"))


# ---- decisions over given scores -----------------------------------------------------------------

_P2 = "(CAST((id * 104729) % 997 AS DOUBLE) / CAST(997 AS DOUBLE))"
def p2_col():
    return ((F.col("id") * 104729) % 997).cast("double") / F.lit(997.0)


@query("blend", f"SELECT id, {r6(f'.6::DOUBLE * score + .4::DOUBLE * {_P2}')} AS p FROM v_scores")
def blend(t):
    return view(t, "v_scores").select("id", rnd(.6 * F.col("score") + .4 * p2_col()).alias("p"))


@query("blend_search", f"WITH w AS (SELECT unnest(range(0, 21)) / 20.0::DOUBLE AS w) SELECT {r6('w')} AS w, {r6(f'avg((w * score + (1 - w) * {_P2} - y) ^ 2)')} AS brier FROM v_scores, w GROUP BY 1")
def blend_search(t):
    """Every weight from one pass: the squared error is a quadratic in w with three aggregated coefficients."""
    d, e = F.col("score") - p2_col(), p2_col() - F.col("y")
    c = view(t, "v_scores").agg(F.avg(d * d).alias("a"), F.avg(d * e).alias("b"), F.avg(e * e).alias("c"))
    w = c.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumn("w", F.col("w") / 20)
    return w.select(rnd("w").alias("w"), rnd(F.col("a") * F.col("w") * F.col("w") + 2 * F.col("b") * F.col("w") + F.col("c")).alias("brier"))


@query("error_correlation", f"SELECT {r6(f'corr(score - y, {_P2} - y)')} AS corr FROM v_scores")
def error_correlation(t):
    return view(t, "v_scores").agg(rnd(F.corr(F.col("score") - F.col("y"), p2_col() - F.col("y"))).alias("corr"))


@query("segment_models", f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE o_custkey % 400 END AS g, CAST(year(o_orderdate) - 1998 AS DOUBLE) AS x, o_totalprice AS y FROM orders), a AS (SELECT avg(x) AS mx, avg(x * x) AS mxx, avg(y) AS my, avg(x * y) AS mxy FROM o),
    w AS (SELECT *, (mxy - mx * my) / (mxx - mx * mx) AS b1, my - (mxy - mx * my) / (mxx - mx * mx) * mx AS b0 FROM a), s AS (SELECT g, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM o GROUP BY 1),
    e AS (SELECT g, n + 20 AS a11, sx + 20 * mx AS a12, sxx + 20 * mxx AS a22, sy + 20 * (b0 + b1 * mx) AS c1, sxy + 20 * (b0 * mx + b1 * mxx) AS c2 FROM s, w)
    SELECT o_orderkey, {r6('(a22 * c1 - a12 * c2) / (a11 * a22 - a12 * a12) + (a11 * c2 - a12 * c1) / (a11 * a22 - a12 * a12) * x', 2)} AS pred FROM o JOIN e ON o.g IS NOT DISTINCT FROM e.g""")
def segment_models(t):
    """A line per segment, pulled towards the line of all rows; thin segments and the null one included."""
    o = t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey") % 400).alias("g"), (F.year("o_orderdate") - 1998).cast("double").alias("x"), "o_totalprice")
    return predict_segments(o, pooled_segments(o, "g", ["x"], "o_totalprice"), "g", ["x"], "p").select("o_orderkey", rnd("p", 2).alias("pred"))


@query("cold_start_fallback", f"WITH u AS (SELECT user_id, count(*) AS n, avg(value) AS m FROM events GROUP BY 1), k AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1) SELECT event_id, CASE WHEN n < 70 THEN 'attributes' ELSE 'history' END AS path, {r6('CASE WHEN n < 70 THEN k.m ELSE u.m END')} AS pred FROM events e JOIN u USING (user_id) JOIN k ON e.event_type = k.event_type")
def cold_start_fallback(t):
    e = t.events.select("event_id", "user_id", "event_type", "value")
    e = group_values(e, ["user_id"], {"n": F.count(F.lit(1)), "um": F.avg("value")})
    e = group_values(e, ["event_type"], {"km": F.avg("value")})
    new = F.col("n") < 70
    return e.select("event_id", F.when(new, "attributes").otherwise("history").alias("path"), rnd(F.when(new, F.col("km")).otherwise(F.col("um"))).alias("pred"))


@query("factor_adjust", f"WITH f AS (SELECT grp, sum(y) / sum(score) AS f FROM v_scores GROUP BY 1) SELECT id, {r6('score * f')} AS adjusted FROM v_scores JOIN f USING (grp)")
def factor_adjust(t):
    s = group_values(view(t, "v_scores").select("id", "grp", "score", "y"), ["grp"], {"a": F.sum("y"), "e": F.sum("score")})
    return s.select("id", rnd(F.col("score") * F.col("a") / F.col("e")).alias("adjusted"))


_LABS = ["good", "toxic", "fr", "long", "short", "src"]
_PROB = "((doc_id * {k} + 17) % 101) / 101.0::DOUBLE"
_LT = {"good": .6, "toxic": .7, "fr": .8, "long": .3, "short": .2, "src": .1}


@query("multilabel_decode", f"""WITH p AS ({' UNION ALL '.join(f"SELECT doc_id, '{c}' AS label, {_PROB.format(k=31 * (i + 1))} AS p, {_LT[c]}::DOUBLE AS th FROM documents" for i, c in enumerate(_LABS))}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(p >= th AS INT) DESC, p DESC, label) AS rn, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, label) AS rp FROM p),
    c AS (SELECT doc_id, sum(CAST(p >= th AS INT)) AS n FROM p GROUP BY 1) SELECT r.doc_id, label FROM r JOIN c USING (doc_id) WHERE (n > 0 AND p >= th AND rn <= 5) OR (n = 0 AND rp = 1)""")
def multilabel_decode(t):
    """Labels above their own threshold, at most five, at least one; decided inside each row's array."""
    cells = F.array(*[F.struct((-(((F.col("doc_id") * (31 * (i + 1)) + 17) % 101) / F.lit(101.0))).alias("np"), F.lit(c).alias("label"), F.lit(_LT[c]).alias("th")) for i, c in enumerate(_LABS)])
    d = t.documents.select("doc_id", F.array_sort(cells).alias("cells"))
    hits = F.slice(F.filter("cells", lambda x: -x["np"] >= x["th"]), 1, 5)
    return d.select("doc_id", F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.slice("cells", 1, 1))).alias("c")).select("doc_id", "c.label")


@query("margin_decode", f"WITH p AS ({' UNION ALL '.join(f'SELECT doc_id, {chr(39)}{c}{chr(39)} AS label, {_PROB.format(k=31 * (i + 1))} - {_LT[c]}::DOUBLE AS m FROM documents' for i, c in enumerate(_LABS))}) SELECT doc_id, arg_max(label, round(m, 9)) AS label FROM p GROUP BY 1")
def margin_decode(t):
    cells = F.array(*[F.struct(F.round(((F.col("doc_id") * (31 * (i + 1)) + 17) % 101) / F.lit(101.0) - _LT[c], 9).alias("m"), F.lit(c).alias("label")) for i, c in enumerate(_LABS)])
    return t.documents.select("doc_id", F.array_max(cells)["label"].alias("label"))


@query("ordinal_decode", f"WITH p AS (SELECT id, score AS g0, score * .7::DOUBLE AS g1, score * .4::DOUBLE AS g2, score * .1::DOUBLE AS g3 FROM v_scores), q AS (SELECT id, [1 - g0, g0 - g1, g1 - g2, g2 - g3, g3] AS p FROM p) SELECT id, {', '.join(r6(f'p[{i + 1}]') + f' AS p{i}' for i in range(5))}, CAST(list_position(list_transform(p, lambda x: round(x, 9)), list_max(list_transform(p, lambda x: round(x, 9)))) - 1 AS INT) AS cls FROM q")
def ordinal_decode(t):
    """Class probabilities from P(y > k): P(0) = 1 - P(>0), P(k) = P(>k-1) - P(>k), P(last) = P(>last-1)."""
    g = [F.col("score") * w for w in (1.0, .7, .4, .1)]
    p = [1 - g[0], g[0] - g[1], g[1] - g[2], g[2] - g[3], g[3]]
    r = F.array(*[F.round(x, 9) for x in p])
    return view(t, "v_scores").select("id", *[rnd(x).alias(f"p{i}") for i, x in enumerate(p)], (F.array_position(r, F.array_max(r)) - 1).cast("int").alias("cls"))


@query("bid_price", f"SELECT id, {r6('greatest(score * 2.5 * .8::DOUBLE, .3 + .01)')} AS bid FROM v_scores")
def bid_price(t):
    return view(t, "v_scores").select("id", rnd(F.greatest(F.col("score") * 2.5 * .8, F.lit(.3 + .01))).alias("bid"))


@query("expected_value_target", f"SELECT grp, count(*) AS targeted, {r6(f'sum(score * {_P2} * 450 - 170)', 2)} AS net_value FROM v_scores WHERE score > .25 AND {_P2} > .4 GROUP BY 1")
def expected_value_target(t):
    s = view(t, "v_scores").filter((F.col("score") > .25) & (p2_col() > .4))
    return s.groupBy("grp").agg(F.count(F.lit(1)).alias("targeted"), rnd(F.sum(F.col("score") * p2_col() * 450 - 170), 2).alias("net_value"))


@query("residual_correction", f"SELECT event_id, {r6('40 + coalesce(avg(value - 40) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS corrected FROM events")
def residual_correction(t):
    """Outside forecast (here a constant 40) plus the entity's mean error on earlier rows."""
    e = running(events(t), ["user_id"], "clock", "event_id", {"s": ("sum", F.col("value") - 40), "n": ("count", F.lit(1))}, include_current=False)
    return e.select("event_id", rnd(40 + F.coalesce(ratio("s", "n"), F.lit(0.0))).alias("corrected"))


@query("label_hierarchy", """WITH c AS (SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), k AS (SELECT n_name FROM c GROUP BY 1 HAVING count(*) >= 60)
    SELECT c_custkey, CASE WHEN n_name IN (SELECT n_name FROM k) THEN n_name ELSE r_name END AS label FROM c UNION SELECT c_custkey, r_name FROM c""")
def label_hierarchy(t):
    """A child label implies its parent; a rare leaf is folded into its parent."""
    closure = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    c = t.customer.select("c_custkey", "c_nationkey")
    n = c.groupBy("c_nationkey").count()
    closure = closure.join(n, "c_nationkey").select("c_nationkey", F.array_distinct(F.array(F.when(F.col("count") >= 60, F.col("n_name")).otherwise(F.col("r_name")), F.col("r_name"))).alias("labels"))
    return c.join(closure, "c_nationkey").select("c_custkey", F.explode("labels").alias("label"))


@query("fallback_route", f"SELECT doc_id, CASE WHEN greatest({', '.join(_PROB.format(k=31 * (i + 1)) for i in range(3))}) < .55 THEN 'human' ELSE 'auto' END AS route FROM documents")
def fallback_route(t):
    p = F.array(*[((F.col("doc_id") * (31 * (i + 1)) + 17) % 101) / F.lit(101.0) for i in range(3)])
    return t.documents.select("doc_id", F.when(F.array_max(p) < .55, "human").otherwise("auto").alias("route"))
