"""Encoders, feature preparation, splits and samples."""

from pyspark.sql import Window as W, functions as F

from larkspur.functions.scalar import flag, mix_hash, poisson1, ratio, rnd
from larkspur.metrics.bootstrap import bootstrap_auc as resampled_auc
from larkspur.operators import encode as en, split as sp
from larkspur.operators.aggregates import target_corr
from larkspur.operators.clean import attach_one
from larkspur.operators.neighbors import knn
from larkspur.operators.prefix import exact_quantiles
from larkspur.operators.windows import group_values
from larkspur.plans.registry import mix, poisson, query, r6
from larkspur.plans.series import events
from larkspur.plans.views import view

_TRAIN = "id % 5 <> 0"


def scores(t):
    return view(t, "v_scores").join(t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 301).alias("unit")), "id")


_SC = "sc AS (SELECT v_scores.*, o_custkey % 301 AS unit FROM v_scores JOIN orders ON id = o_orderkey)"
def train_col():
    return F.col("id") % 5 != 0


@query("frequency_encode", f"WITH {_SC}, f AS (SELECT unit, count(*) / (SELECT count(*) FROM sc WHERE {_TRAIN} AND unit > 20) AS f FROM sc WHERE {_TRAIN} AND unit > 20 GROUP BY 1) SELECT id, {r6('coalesce(f, 0)', 8)} AS unit_freq FROM sc LEFT JOIN f USING (unit)")
def frequency_encode(t):
    return en.frequency_encode(scores(t), "unit", train_col() & (F.col("unit") > 20), "f").select("id", rnd("f", 8).alias("unit_freq"))


_TE = f"WITH {_SC}, s AS (SELECT unit, count(*) AS n, avg(y) AS m FROM sc WHERE {_TRAIN} AND unit > 20 GROUP BY 1), g AS (SELECT avg(y) AS g FROM sc WHERE {_TRAIN} AND unit > 20)"


@query("target_encode_sigmoid", f"{_TE} SELECT id, {r6('coalesce(m / (1 + exp(10.0::DOUBLE - n)) + (1 - 1 / (1 + exp(10.0::DOUBLE - n))) * g, g)')} AS enc FROM sc LEFT JOIN s USING (unit), g")
def target_encode_sigmoid(t):
    return en.target_encode(scores(t), "unit", "y", train_col() & (F.col("unit") > 20), "e", 10, "sigmoid").select("id", rnd("e").alias("enc"))


@query("target_encode_m", f"{_TE} SELECT id, {r6('coalesce((n * m + 10 * g) / (n + 10), g)')} AS enc FROM sc LEFT JOIN s USING (unit), g")
def target_encode_m(t):
    return en.target_encode(scores(t), "unit", "y", train_col() & (F.col("unit") > 20), "e", 10).select("id", rnd("e").alias("enc"))


@query("target_encode_oof", f"""WITH {_SC}, f AS (SELECT *, id % 5 AS fold FROM sc), v AS (SELECT unit, sum(y) AS s, count(*) AS n FROM f GROUP BY 1), o AS (SELECT unit, fold, sum(y) AS s, count(*) AS n FROM f GROUP BY 1, 2), g AS (SELECT fold, ((SELECT sum(y) FROM f) - sum(y)) / ((SELECT count(*) FROM f) - count(*)) AS g FROM f GROUP BY 1)
    SELECT id, {r6('(v.s - o.s + 10 * g) / (v.n - o.n + 10)')} AS enc FROM f JOIN v USING (unit) JOIN o ON f.unit = o.unit AND f.fold = o.fold JOIN g ON f.fold = g.fold""")
def target_encode_oof(t):
    f = scores(t).withColumn("fold", F.col("id") % 5)
    return en.target_encode_oof(f, "unit", "y", "fold", "e", 10).select("id", rnd("e").alias("enc"))


@query("hash_features")
def hash_features(t):
    h = en.signed_hash(["p_brand", "p_type", "p_size"], [["p_brand", "p_type"]], 1 << 20)
    return t.part.select("p_partkey", F.inline(h))


@query("one_hot", "WITH k AS (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 70 ORDER BY count(*) DESC, p_brand LIMIT 10) SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM k) THEN p_brand ELSE 'infrequent' END AS feature, 1 AS value FROM part")
def one_hot(t):
    p = t.part.select("p_partkey", "p_brand")
    keep = p.groupBy("p_brand").count().filter("count >= 70").orderBy(F.desc("count"), "p_brand").limit(10).agg(F.collect_list("p_brand")).scalar()
    return p.select("p_partkey", F.when(F.array_contains(keep, F.col("p_brand")), F.col("p_brand")).otherwise("infrequent").alias("feature"), F.lit(1).alias("value"))


_ROWS = "l_orderkey, l_linenumber"


@query("standard_scale", f"WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem WHERE l_orderkey % 5 <> 0) SELECT {_ROWS}, {r6('(l_quantity - mq) / sq')} AS l_quantity, {r6('(l_extendedprice - mp) / sp')} AS l_extendedprice FROM lineitem, s")
def standard_scale(t):
    cols = ["l_quantity", "l_extendedprice"]
    li = en.standard_scale(t.lineitem.select("l_orderkey", "l_linenumber", *cols), cols, F.col("l_orderkey") % 5 != 0)
    return li.select("l_orderkey", "l_linenumber", *[rnd(c).alias(c) for c in cols])


@query("robust_scale", f"WITH s AS (SELECT quantile_cont(l_extendedprice, .5) AS m, quantile_cont(l_extendedprice, .75) - quantile_cont(l_extendedprice, .25) AS w FROM lineitem WHERE l_orderkey % 5 <> 0) SELECT {_ROWS}, {r6('(l_extendedprice - m) / w')} AS l_extendedprice FROM lineitem, s")
def robust_scale(t):
    li = en.robust_scale(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice"], F.col("l_orderkey") % 5 != 0)
    return li.select("l_orderkey", "l_linenumber", rnd("l_extendedprice").alias("l_extendedprice"))


def _mi_sql(col, y, table):
    return f"SELECT '{col}' AS feature, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM (SELECT {col} AS x, {y} AS y, count(*)::DOUBLE AS n FROM {table} GROUP BY 1, 2))"


@query("mutual_info", "WITH b AS (SELECT o_orderpriority, year(o_orderdate) AS yr, CAST(least(floor(o_totalprice / 50000), 9) AS INT) AS price_bin, o_orderstatus FROM orders) " + f"SELECT feature, {r6('mi', 8)} AS mi FROM (" + " UNION ALL ".join(_mi_sql(c, "o_orderstatus", "b") for c in ("o_orderpriority", "yr", "price_bin")) + ")")
def mutual_info(t):
    b = t.orders.select("o_orderpriority", F.year("o_orderdate").alias("yr"), F.least(F.floor(F.col("o_totalprice") / 50000), F.lit(9)).alias("price_bin"), "o_orderstatus")
    return en.mutual_info(b, ["o_orderpriority", "yr", "price_bin"], "o_orderstatus").select("feature", rnd("mi", 8).alias("mi"))


@query("bias_feature_drop", f"""WITH r AS (SELECT x1, x2, x3, y_hat, y, CAST(x1 > 25 AS INT) AS g FROM v_reg), c AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, abs(corr({c}, g)) AS cg, abs(corr({c}, y)) AS cy FROM r" for c in ('x1', 'x2', 'x3', 'y_hat'))})
    SELECT feature, {r6('cg', 5)} AS corr_group, {r6('cy', 5)} AS corr_target, CAST(cg > .2 AND cy < .05 AS INT) AS dropped FROM c""")
def bias_feature_drop(t):
    cols = ["x1", "x2", "x3", "y_hat"]
    r = view(t, "v_reg").select(*cols, "y", flag(F.col("x1") > 25).alias("g"))
    a = target_corr(r, cols, "g").select("feature", F.abs("corr").alias("cg"))
    b = target_corr(r, cols, "y").select("feature", F.abs("corr").alias("cy"))
    return a.join(b, "feature").select("feature", rnd("cg", 5).alias("corr_group"), rnd("cy", 5).alias("corr_target"), flag((F.col("cg") > .2) & (F.col("cy") < .05)).alias("dropped"))


@query("ips_weight", f"""WITH r AS (SELECT event_type, hour(ts) AS h, avg(CAST(value > 20 AS INT)) AS p FROM events GROUP BY 1, 2) SELECT event_id, {r6('1 / least(greatest(p, .01), 1)')} AS weight FROM events JOIN r ON events.event_type = r.event_type AND hour(ts) = h""")
def ips_weight(t):
    e = t.events.select("event_id", "event_type", F.hour("ts").alias("h"), flag(F.col("value") > 20).alias("won"))
    e = group_values(e, ["event_type", "h"], {"p": F.avg("won")})
    return e.select("event_id", rnd(1 / F.least(F.greatest("p", F.lit(.01)), F.lit(1.0))).alias("weight"))


@query("class_weights", f"WITH c AS (SELECT y, count(*) AS n FROM v_scores GROUP BY 1) SELECT y, n, {r6('(SELECT sum(n) / count(*) FROM c) / n')} AS weight, {r6('((SELECT sum(n) FROM c) - n) / n')} AS odds FROM c")
def class_weights(t):
    c = en.class_weights(view(t, "v_scores"), "y")
    return c.withColumn("tot", c.agg(F.sum("n")).scalar()).select("y", "n", rnd("weight").alias("weight"), rnd((F.col("tot") - F.col("n")) / F.col("n")).alias("odds"))


# ---- splits and samples --------------------------------------------------------------------------

@query("stratified_split", f"SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY {mix('o_orderkey')}, o_orderkey) <= floor(.2 * count(*) OVER (PARTITION BY o_orderstatus)) AS INT) AS is_test FROM orders")
def stratified_split(t):
    return sp.stratified_split(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus").select("o_orderkey", "is_test")


@query("kfold", f"SELECT o_orderkey, CAST((row_number() OVER (ORDER BY {mix('o_orderkey')}, o_orderkey) - 1) % 5 AS INT) AS fold FROM orders")
def kfold(t):
    return sp.kfold(t.orders.select("o_orderkey"), "o_orderkey").select("o_orderkey", "fold")


@query("stratified_kfold", f"SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {mix('o_orderkey')}, o_orderkey) - 1) % 5 AS INT) AS fold FROM orders")
def stratified_kfold(t):
    return sp.kfold(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", cls=["o_orderstatus"]).select("o_orderkey", "fold")


@query("group_kfold", "WITH s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1), r AS (SELECT *, (row_number() OVER (ORDER BY size DESC, o_custkey) - 1) % 10 AS p FROM s) SELECT o_custkey, size, CAST(CASE WHEN p < 5 THEN p ELSE 9 - p END AS INT) AS fold FROM r")
def group_kfold(t):
    return sp.group_kfold(t.orders, "o_custkey")


@query("time_series_split", "WITH b AS (SELECT event_id, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) * 6 / (SELECT count(*) FROM events)) AS INT) AS block FROM events) SELECT event_id, block FROM b")
def time_series_split(t):
    return sp.time_blocks(events(t).select("event_id", "clock"), "clock", "event_id", 6).select("event_id", "block")


@query("date_split", "WITH q AS (SELECT quantile_cont(CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE), .85) AS q FROM orders) SELECT o_orderkey, CASE WHEN date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) > q THEN 'test' WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'valid' ELSE 'train' END AS part_of FROM orders, q")
def date_split(t):
    o = t.orders.select("o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("day"), "o_orderdate")
    cut = exact_quantiles(o, "day", {"q": .85}).scalar()
    return o.select("o_orderkey", F.when(F.col("day") > cut, "test").when(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"), "valid").otherwise("train").alias("part_of"))


@query("walk_forward", """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT CAST(unnest(generate_series((SELECT date_trunc('month', min(d)) + INTERVAL 48 MONTH FROM o), (SELECT date_trunc('month', max(d))::TIMESTAMP FROM o), INTERVAL 1 MONTH)) AS DATE) AS m)
    SELECT CAST(m AS VARCHAR) AS test_month, CAST(coalesce(sum(n) FILTER (d >= m - INTERVAL 48 MONTH AND d < m - INTERVAL 5 DAY), 0) AS BIGINT) AS n_train, CAST(coalesce(sum(n) FILTER (d >= m AND d < m + INTERVAL 1 MONTH), 0) AS BIGINT) AS n_test FROM f, o GROUP BY 1""")
def walk_forward(t):
    """Four years of training, five days of embargo, one test month; each day is sent to its folds by month arithmetic."""
    month = lambda d: F.trunc(d, "month")
    days = t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    first = F.add_months(month(F.date_add("d", 5)), 1)
    months = F.sequence(first, F.greatest(F.add_months(month("d"), 48), first), F.expr("interval 1 month"))
    train = days.select("n", "d", F.explode(months).alias("m")).filter((F.col("d") >= F.add_months("m", -48)) & (F.col("d") < F.date_add("m", -5))).groupBy("m").agg(F.sum("n").alias("n_train"))
    test = days.groupBy(month("d").alias("m")).agg(F.sum("n").alias("n_test"))
    ends = days.agg(F.add_months(month(F.min("d")), 48).alias("a"), month(F.max("d")).alias("b")).filter("a <= b")
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    return spine.join(train, "m", "left").join(test, "m", "left").select(F.col("m").cast("string").alias("test_month"), F.coalesce("n_train", F.lit(0)).alias("n_train"), F.coalesce("n_test", F.lit(0)).alias("n_test"))


@query("group_time_split", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')")
def group_time_split(t):
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    seen = t.orders.filter(F.col("o_orderdate") < cut).select("o_custkey")
    return t.orders.filter(F.col("o_orderdate") >= cut).join(seen, "o_custkey", "left_anti").select("o_orderkey")


@query("bootstrap_sample", f"SELECT rep, count(*) AS n_rows, CAST(sum(w) AS BIGINT) AS n_drawn, CAST(sum(CAST(w = 0 AS INT)) AS BIGINT) AS out_of_bag FROM (SELECT CAST(rep AS INT) AS rep, {poisson(mix('id', 'rep'))} AS w FROM v_scores, range(0, 20) r(rep)) GROUP BY 1")
def bootstrap_sample(t):
    w = sp.bootstrap_weights(view(t, "v_scores").select("id"), "id", 20)
    return w.groupBy("rep").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("w").alias("n_drawn"), F.sum(flag(F.col("w") == 0)).alias("out_of_bag"))


@query("bootstrap_ci", f"""WITH b AS (SELECT rep, sum(w * CAST((score >= .5) = (y = 1) AS INT)) / sum(w) AS acc FROM (SELECT rep, y, score, {poisson('u')} AS w FROM (SELECT rep, y, score, {mix('id', 'rep')} AS u FROM v_scores, range(0, 1000) r(rep))) GROUP BY 1)
    SELECT {r6('quantile_cont(acc, .025)')} AS low, {r6('avg(acc)')} AS mean, {r6('quantile_cont(acc, .975)')} AS high FROM b""")
def bootstrap_ci(t):
    s = view(t, "v_scores")
    b = sp.bootstrap_metric(s, "id", flag((F.col("score") >= .5) == (F.col("y") == 1)), 1000)
    # one row per resample: 1000 values, so the built-in percentile is bounded
    return b.agg(rnd(F.percentile("value", F.lit(.025))).alias("low"), rnd(F.avg("value")).alias("mean"), rnd(F.percentile("value", F.lit(.975))).alias("high"))


@query("bootstrap_auc", f"""WITH g AS (SELECT rep, score, sum(w * y) AS p, sum(w * (1 - y)) AS n FROM (SELECT rep, y, score, {poisson('u')} AS w FROM (SELECT rep, y, score, {mix('id', 'rep')} AS u FROM v_scores, range(0, 1000) r(rep))) GROUP BY 1, 2),
    a AS (SELECT rep, sum(p * (below - n / 2.0::DOUBLE)) / (sum(p) * sum(n)) AS auc FROM (SELECT *, sum(n) OVER (PARTITION BY rep ORDER BY score) AS below FROM g) GROUP BY 1)
    SELECT {r6('quantile_cont(auc, .025)')} AS low, {r6('avg(auc)')} AS mean, {r6('quantile_cont(auc, .975)')} AS high FROM a""")
def bootstrap_auc(t):
    """A 95 per cent interval of the AUC from 1,000 resamples, ranked in one sorted pass."""
    b = resampled_auc(view(t, "v_scores"), "id", "score", "y", 1000)
    return b.agg(rnd(F.percentile("auc", F.lit(.025))).alias("low"), rnd(F.avg("auc")).alias("mean"), rnd(F.percentile("auc", F.lit(.975))).alias("high"))


def vectors(t, cond=None):
    e = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    return e.filter(cond) if cond is not None else e


@query("smote")
def smote(t):
    """Synthetic minority rows: each minority row steps a hashed share of the way to a hashed one of its 5 neighbours."""
    m = vectors(t, F.col("label") == 0)
    hits = knn(m, m, 5, "vec_id", "vec_id", rule="not_self")
    pick = hits.withColumn("want", 1 + F.floor(mix_hash("qid", 3) * 5)).filter(F.col("rn") == F.col("want"))
    a, b = m.select(F.col("vec_id").alias("qid"), F.col("vec").alias("va")), m.select(F.col("vec_id").alias("bid"), F.col("vec").alias("vb"))
    step = mix_hash("qid", 4)
    out = pick.join(a, "qid").join(b, "bid").withColumn("step", step)
    return out.select("qid", "bid", F.zip_with("va", "vb", lambda x, y: x + (y - x) * F.col("step")).alias("vec"))


_D = "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("tomek_links", f"""WITH d AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, CAST(a.label < 5 AS INT) AS ca, CAST(b.label < 5 AS INT) AS cb, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D}, b.vec_id) AS rn FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), n AS MATERIALIZED (SELECT * FROM d WHERE rn = 1)
    SELECT x.a, x.b FROM n x JOIN n y ON x.a = y.b AND x.b = y.a WHERE x.ca <> x.cb AND x.a < x.b""")
def tomek_links(t):
    v = vectors(t)
    n = knn(v, v, 1, "vec_id", "vec_id", rule="not_self").select(F.col("qid").alias("a"), F.col("bid").alias("b"))
    back = n.select(F.col("a").alias("b"), F.col("b").alias("a"))
    c = v.select(F.col("vec_id"), (F.col("label") < 5).alias("c"))
    mutual = n.join(back, ["a", "b"]).filter("a < b")
    return (mutual.join(c.withColumnsRenamed({"vec_id": "a", "c": "ca"}), "a").join(c.withColumnsRenamed({"vec_id": "b", "c": "cb"}), "b").filter("ca <> cb").select("a", "b"))


@query("under_sample", f"SELECT id FROM v_scores WHERE y = 1 OR {mix('id', 5)} < .25")
def under_sample(t):
    return view(t, "v_scores").filter((F.col("y") == 1) | (mix_hash("id", 5) < .25)).select("id")


@query("learning_curve_samples", f"SELECT share, count(*) AS n, {r6('avg(y)')} AS rate FROM v_scores, (VALUES (.1::DOUBLE), (.25::DOUBLE), (.5::DOUBLE), (.75::DOUBLE), (1.0::DOUBLE)) s(share) WHERE {mix('id', 6)} < share GROUP BY 1")
def learning_curve_samples(t):
    s = view(t, "v_scores").withColumn("u", mix_hash("id", 6))
    shares = F.filter(F.array(*[F.lit(x) for x in (.1, .25, .5, .75, 1.0)]), lambda x: F.col("u") < x)
    return s.select("y", F.explode(shares).alias("share")).groupBy("share").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("y")).alias("rate"))


@query("exploration_arm", f"SELECT event_id, CAST({mix('user_id', 7)} < .05 AS INT) AS explore FROM events")
def exploration_arm(t):
    return t.events.select("event_id", flag(mix_hash("user_id", 7) < .05).alias("explore"))


@query("cohort_split", "WITH f AS (SELECT o_custkey, min(year(o_orderdate)) AS cohort FROM orders GROUP BY 1) SELECT o_custkey, CAST(cohort AS INT) AS cohort, CASE WHEN cohort = (SELECT max(cohort) FROM f) THEN 'valid' ELSE 'train' END AS part_of FROM f")
def cohort_split(t):
    f = t.orders.groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("cohort"))
    return f.withColumn("part_of", F.when(F.col("cohort") == f.agg(F.max("cohort")).scalar(), "valid").otherwise("train"))


@query("leave_one_group_out", f"WITH g AS (SELECT seg, sum(y) AS s, count(*) AS n FROM v_reg GROUP BY 1), m AS (SELECT g.seg, ((SELECT sum(s) FROM g) - s) / ((SELECT sum(n) FROM g) - n) AS mean FROM g) SELECT r.seg AS held_out, count(*) AS n, {r6('sqrt(avg((y - mean) ^ 2))', 3)} AS rmse FROM v_reg r JOIN m ON r.seg = m.seg GROUP BY 1")
def leave_one_group_out(t):
    """Each segment scored with the mean learned on all the others."""
    r = view(t, "v_reg").select("seg", "y")
    g = r.groupBy("seg").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    g = attach_one(g, g.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))).select("seg", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("mean"))
    return r.join(g, "seg").groupBy(F.col("seg").alias("held_out")).agg(F.count(F.lit(1)).alias("n"), rnd(F.sqrt(F.avg(F.pow(F.col("y") - F.col("mean"), 2))), 3).alias("rmse"))
