"""Aggregations."""

from pyspark.sql import Window as W, functions as F

from larkspur.functions.scalar import flag, ratio, rnd
from larkspur.operators import aggregates as agg, clean
from larkspur.operators.calendar import densify
from larkspur.operators.prefix import exact_quantiles
from larkspur.operators.windows import group_values, over_rows
from larkspur.operators.sketches import add_days, distinct_between, quantiles_between
from larkspur.plans.registry import query, r6
from larkspur.plans.views import view
from larkspur.session import scratch_path



@query("profile_table", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{d}' AS dtype, count(*) AS n_rows, count(*) - count({c}) AS n_null, {r6(f'(count(*) - count({c})) / count(*)')} AS null_share,
    count(DISTINCT {c}) AS n_distinct, {r6(n('min'))} AS "min", {r6(n('max'))} AS "max", {r6(n('avg'))} AS mean FROM v_gap"""
    for c, d, n in [("event_id", "bigint", lambda f: f"{f}(event_id)"), ("user_id", "bigint", lambda f: f"{f}(user_id)"),
                    ("event_type", "string", lambda f: "NULL"), ("value", "double", lambda f: f"{f}(value)")]))
def profile_table(t):
    p = agg.profile(view(t, "v_gap").select("event_id", "user_id", "event_type", "value"))
    return p.select("column", "dtype", "n_rows", "n_null", rnd(F.col("n_null") / F.col("n_rows")).alias("null_share"), "n_distinct",
                    rnd("min").alias("min"), rnd("max").alias("max"), rnd("mean").alias("mean"))


@query("value_counts", f"SELECT event_type, count(*) AS n, {r6('count(*) / (SELECT count(*) FROM events)')} AS share FROM events GROUP BY 1")
def value_counts(t):
    return agg.value_counts(t.events, "event_type").select("event_type", "n", rnd("share").alias("share")).orderBy(F.desc("n"))


@query("distinct_count", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY 1")
def distinct_count(t):
    o = t.orders.select("o_orderstatus", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return o.groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("day").alias("days"))


def order_sketches(t):
    """Orders sketched by day in two runs; the second adds its days and reads none of the first's."""
    path = scratch_path(t.spark, "sketches")
    o = t.orders.select("o_orderdate", "o_orderstatus", "o_custkey", "o_totalprice")
    for part in (F.year("o_orderdate") < 1998, F.year("o_orderdate") >= 1998):
        add_days(o.filter(part).withColumn("o_orderdate", F.trunc("o_orderdate", "month")), path, "o_orderdate", ["o_orderstatus"], "o_custkey", "o_totalprice")
    return o, path


@query("approx_distinct", "SELECT o_orderstatus, count(*) AS n, true AS near FROM orders GROUP BY 1")
def approx_distinct(t):
    """Distinct customers from stored sketches, and whether they lie within 5 per cent of the exact count."""
    o, path = order_sketches(t)
    exact = o.groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("exact"))
    return distinct_between(t.spark, path, ["o_orderstatus"]).join(exact, "o_orderstatus").select("o_orderstatus", "n", (F.abs(F.col("distinct") - F.col("exact")) <= .05 * F.col("exact")).alias("near"))


@query("group_stats", f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {r6('avg(l_extendedprice)', 3)} AS mean, {r6('quantile_cont(l_extendedprice, 0.5)', 3)} AS median,
    {r6('stddev_samp(l_extendedprice)', 3)} AS std FROM lineitem GROUP BY 1, 2""")
def group_stats(t):
    keys = ["l_returnflag", "l_linestatus"]
    li = t.lineitem.select(*keys, "l_extendedprice")
    s = li.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("mean"), F.stddev_samp("l_extendedprice").alias("std"))
    s = s.join(exact_quantiles(li, "l_extendedprice", {"median": 0.5}, keys), keys)
    return s.select(*keys, "n", rnd("mean", 3).alias("mean"), rnd("median", 3).alias("median"), rnd("std", 3).alias("std"))


@query("group_describe", f"""SELECT event_type, count(value) AS n, {r6('avg(value)')} AS mean, {r6('stddev_samp(value)')} AS std, {r6('min(value)')} AS "min", {r6('quantile_cont(value, .25)')} AS q1,
    {r6('quantile_cont(value, .5)')} AS q2, {r6('quantile_cont(value, .75)')} AS q3, {r6('max(value)')} AS "max" FROM v_gap GROUP BY 1""")
def group_describe(t):
    g = view(t, "v_gap").select("event_type", "value")
    s = g.groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    s = s.join(exact_quantiles(g, "value", {"q1": .25, "q2": .5, "q3": .75}, ["event_type"]), "event_type")
    return s.select("event_type", "n", *[rnd(c).alias(c) for c in ("mean", "std", "min", "q1", "q2", "q3", "max")])


@query("conditional_agg", f"""SELECT user_id, {r6("avg(CASE WHEN event_type = 'purchase' THEN value END)")} AS severity, {r6("avg(CAST(event_type = 'purchase' AS INT))")} AS frequency,
    {r6("avg(CAST(event_type = 'purchase' AS INT)) * avg(CASE WHEN event_type = 'purchase' THEN value END)")} AS expected FROM events GROUP BY 1""")
def conditional_agg(t):
    buy = F.col("event_type") == "purchase"
    sev, freq = F.avg(F.when(buy, F.col("value"))), F.avg(flag(buy))
    return t.events.groupBy("user_id").agg(rnd(sev).alias("severity"), rnd(freq).alias("frequency"), rnd(freq * sev).alias("expected"))


@query("quantiles_exact", f"SELECT {r6('quantile_cont(value, .1)')} AS p10, {r6('quantile_cont(value, .5)')} AS p50, {r6('quantile_cont(value, .9)')} AS p90, {r6('quantile_cont(value, .99)')} AS p99 FROM events")
def quantiles_exact(t):
    q = exact_quantiles(t.events.select("value"), "value", {"p10": .1, "p50": .5, "p90": .9, "p99": .99})
    return q.select(*[rnd(c).alias(c) for c in q.columns])


@query("quantiles_approx", "SELECT o_orderstatus, p, true AS near FROM (SELECT DISTINCT o_orderstatus FROM orders), (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS p)")
def quantiles_approx(t):
    """Quantiles from stored sketches, and whether their rank is within one per cent of what was asked."""
    o, path = order_sketches(t)
    q = quantiles_between(t.spark, path, ["o_orderstatus"], [.1, .5, .9])
    wide = q.groupBy("o_orderstatus").agg(F.collect_list(F.struct("p", "value")).alias("qs"))
    below = o.join(wide, "o_orderstatus").select("o_orderstatus", "o_totalprice", F.inline("qs"))
    ranks = below.groupBy("o_orderstatus", "p").agg(F.avg((F.col("o_totalprice") <= F.col("value")).cast("int")).alias("rank"))
    return ranks.select("o_orderstatus", "p", (F.abs(F.col("rank") - F.col("p")) <= .01).alias("near"))


@query("shape_moments", f"""SELECT event_type, {r6('skewness(value)', 5)} AS skew_corrected, {r6('skewness(value) * (count(*) - 2) / sqrt(count(*)::DOUBLE * (count(*) - 1))', 5)} AS skew, {r6('kurtosis_pop(value)', 5)} AS kurtosis FROM events GROUP BY 1""")
def shape_moments(t):
    return t.events.groupBy("event_type").agg(rnd(clean.corrected_skew("value"), 5).alias("skew_corrected"), rnd(F.skewness("value"), 5).alias("skew"), rnd(F.kurtosis("value"), 5).alias("kurtosis"))


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})', 5)} AS corr FROM lineitem" for i, a in enumerate(_LI) for b in _LI[i:]))
def corr_matrix(t):
    return agg.pair_matrix(t.lineitem, _LI).select("a", "b", rnd("v", 5).alias("corr"))


@query("corr_target_rank", f"""SELECT * FROM ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {r6(f'corr({c}, l_extendedprice)', 5)} AS corr FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax"))}) ORDER BY abs(corr) DESC LIMIT 2""")
def corr_target_rank(t):
    return agg.target_corr(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").limit(2).select("feature", rnd("corr", 5).alias("corr"))


@query("corr_drop")
def corr_drop(t):
    r = view(t, "v_reg").select("x1", "x2", "x3", "y", "y_hat")
    gone = agg.corr_drop(r, r.columns)
    return agg.target_corr(r, [c for c in r.columns if c not in gone], "y").select("feature", rnd("corr", 5).alias("corr"))


@query("leak_scan", f"""SELECT * FROM ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {r6(f'corr({c}, y)', 5)} AS corr FROM v_reg" for c in ("x1", "x2", "x3", "y_hat"))}) WHERE abs(corr) > 0.95""")
def leak_scan(t):
    return agg.target_corr(view(t, "v_reg"), ["x1", "x2", "x3", "y_hat"], "y").filter(F.abs("corr") > 0.95).select("feature", rnd("corr", 5).alias("corr"))


@query("crosstab_rate", f"""SELECT o_orderpriority, {', '.join(r6(f"avg(CAST(o_orderstatus = '{s}' AS INT))") + f' AS share_{s}' for s in 'FOP')} FROM orders GROUP BY 1""")
def crosstab_rate(t):
    c = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    total = F.col("F") + F.col("O") + F.col("P")
    return c.select("o_orderpriority", *[rnd(F.col(s) / total).alias(f"share_{s}") for s in "FOP"])


_MODE = "SELECT o_custkey, o_orderpriority AS mode, n, total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) rn, CAST(sum(n) OVER (PARTITION BY o_custkey) AS BIGINT) AS total FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE rn = 1"


@query("group_mode", _MODE)
def group_mode(t):
    return agg.modal_value(t.orders, ["o_custkey"], "o_orderpriority").select("o_custkey", "mode", "n", "total")


@query("proxy_scan", f"SELECT c_nationkey, c_mktsegment AS mode, {r6('n / total')} AS share FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) rn, sum(n) OVER (PARTITION BY c_nationkey) AS total FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)) WHERE rn = 1")
def proxy_scan(t):
    return agg.modal_value(t.customer, ["c_nationkey"], "c_mktsegment").select("c_nationkey", "mode", rnd(F.col("n") / F.col("total")).alias("share"))


@query("weighted_mean", f"SELECT l_returnflag, {r6('sum(l_extendedprice * l_quantity) / sum(l_quantity)', 3)} AS wmean FROM lineitem GROUP BY 1")
def weighted_mean(t):
    return t.lineitem.groupBy("l_returnflag").agg(rnd(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 3).alias("wmean"))


@query("time_decay_weight", f"""WITH a AS (SELECT *, 0.5 ^ (date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') / 365.0::DOUBLE) AS w FROM orders)
    SELECT o_custkey, {r6('sum(w * o_totalprice) / sum(w)', 3)} AS decayed_mean, {r6('sum(w)')} AS weight FROM a GROUP BY 1""")
def time_decay_weight(t):
    age = F.datediff(F.lit("2001-08-01").cast("date"), F.col("o_orderdate").cast("date"))
    o = t.orders.select("o_custkey", "o_totalprice", F.pow(F.lit(0.5), age / F.lit(365.0)).alias("w"))
    return o.groupBy("o_custkey").agg(rnd(F.sum(F.col("w") * F.col("o_totalprice")) / F.sum("w"), 3).alias("decayed_mean"), rnd(F.sum("w")).alias("weight"))


@query("hierarchy_rollup", f"""SELECT coalesce(r_name, 'ALL') AS region, coalesce(n_name, 'ALL') AS nation, CAST(grouping(r_name) * 2 + grouping(n_name) AS BIGINT) AS level, {r6('sum(c_acctbal)', 2)} AS total, count(*) AS n
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def hierarchy_rollup(t):
    c = t.customer.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("v"), F.count(F.lit(1)).alias("c"))
    h = c.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    r = h.rollup("r_name", "n_name").agg(F.grouping_id().alias("level"), F.sum("v").alias("total"), F.sum("c").alias("n"))
    return r.select(F.coalesce("r_name", F.lit("ALL")).alias("region"), F.coalesce("n_name", F.lit("ALL")).alias("nation"), "level", rnd("total", 2).alias("total"), "n")


@query("top_down_allocate", f"""WITH h AS (SELECT c_nationkey, sum(c_acctbal) AS v FROM customer GROUP BY 1)
    SELECT c_nationkey, {r6('v / sum(v) OVER ()')} AS share, {r6('1000000 * v / sum(v) OVER ()', 4)} AS allocated FROM h""")
def top_down_allocate(t):
    h = t.customer.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("v"))
    share = F.col("v") / h.agg(F.sum("v")).scalar()
    return h.select("c_nationkey", rnd(share).alias("share"), rnd(1000000 * share, 4).alias("allocated"))


_CELLS = "SELECT user_id, CAST(ts AS DATE) AS d, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS units FROM events GROUP BY 1, 2"


@query("series_tier", f"""WITH c AS ({_CELLS}), s AS (SELECT user_id, avg(CAST(units > 0 AS INT)) AS share FROM c GROUP BY 1)
    SELECT user_id, CASE WHEN share >= .5 THEN 'HIGH' WHEN share >= .1 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM s""")
def series_tier(t):
    s = _cells(t).groupBy("user_id").agg(F.avg(flag(F.col("units") > 0)).alias("share"))
    return s.select("user_id", F.when(F.col("share") >= .5, "HIGH").when(F.col("share") >= .1, "MEDIUM").otherwise("LOW").alias("tier"))


def _cells(t):
    return t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.sum(flag(F.col("event_type") == "purchase")).alias("units"))


@query("zero_share", f"WITH c AS ({_CELLS}) SELECT user_id, {r6('avg(CAST(units = 0 AS INT))')} AS zero_share FROM c GROUP BY 1")
def zero_share(t):
    return _cells(t).groupBy("user_id").agg(rnd(F.avg(flag(F.col("units") == 0))).alias("zero_share"))


_SENSOR = ["n", "mean", "std", "min", "max", "range", "slope", "phase1", "phase2", "phase3", "spikes", "max_step", "mean_step", "p5", "p25", "median", "p75", "p95"]


@query("sensor_features", f"""WITH r AS (SELECT user_id, event_type, value AS x, row_number() OVER w - 1 AS i, lag(value) OVER w AS prev, count(*) OVER (PARTITION BY user_id, event_type) AS cnt,
      avg(value) OVER (PARTITION BY user_id, event_type) AS m, stddev_pop(value) OVER (PARTITION BY user_id, event_type) AS s FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
    SELECT user_id, event_type, {r6('count(*)')} AS n, {r6('avg(x)')} AS mean, {r6('stddev_pop(x)')} AS std, {r6('min(x)')} AS "min", {r6('max(x)')} AS "max", {r6('max(x) - min(x)')} AS "range",
    {r6('CASE WHEN count(*) > 1 THEN regr_slope(x, i) END')} AS slope, {r6('avg(CASE WHEN i < cnt // 3 THEN x END)')} AS phase1, {r6('avg(CASE WHEN i >= cnt // 3 AND i < 2 * (cnt // 3) THEN x END)')} AS phase2,
    {r6('avg(CASE WHEN i >= 2 * (cnt // 3) THEN x END)')} AS phase3, {r6('sum(CAST(abs(x) > m + 2 * s AS INT))')} AS spikes, {r6('max(abs(x - prev))')} AS max_step, {r6('avg(abs(x - prev))')} AS mean_step,
    {', '.join(r6(f'quantile_cont(x, {q})') + f' AS {n}' for n, q in (('p5', .05), ('p25', .25), ('median', .5), ('p75', .75), ('p95', .95)))} FROM r GROUP BY 1, 2""")
def sensor_features(t):
    e = t.events.withColumn("clock", F.unix_micros(F.col("ts").cast("timestamp")))
    s = agg.sensor_features(e, ["user_id", "event_type"], "clock", "event_id", "value")
    return s.select("user_id", "event_type", *[rnd(c).alias(c) for c in _SENSOR])


@query("spectral_features", f"""WITH r AS (SELECT user_id, value AS x, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS i FROM events),
    f AS (SELECT *, i // 32 AS frame, i % 32 AS tt, count(*) OVER (PARTITION BY user_id, i // 32) AS n FROM r),
    w AS (SELECT *, unnest(range(0, CAST(n // 2 + 1 AS BIGINT))) AS k FROM f),
    m AS (SELECT user_id, frame, k, sqrt(sum(x * cos(2 * pi() * k * tt / n)) ^ 2 + sum(x * sin(2 * pi() * k * tt / n)) ^ 2) AS mag FROM w GROUP BY ALL),
    d AS (SELECT user_id, frame, k, row_number() OVER (PARTITION BY user_id, frame ORDER BY round(mag, 6) DESC, k) AS rn FROM m WHERE k > 0)
    SELECT m.user_id, CAST(m.frame AS BIGINT) AS frame, {r6('max(d.k)')} AS dominant, {r6('sum(mag ^ 2)', 3)} AS energy, {r6('coalesce(sum(mag) FILTER (m.k >= 6), 0) / (sum(mag) + 1e-10)')} AS high_share
    FROM m LEFT JOIN d ON m.user_id = d.user_id AND m.frame = d.frame AND d.rn = 1 GROUP BY 1, 2""")
def spectral_features(t):
    e = t.events.withColumn("clock", F.unix_micros(F.col("ts").cast("timestamp")))
    s = agg.spectral_features(e, ["user_id"], "clock", "event_id", "value", frame=32, high_from=6)
    return s.select("user_id", "frame", rnd("dominant").alias("dominant"), rnd("energy", 3).alias("energy"), rnd("high_share").alias("high_share"))


@query("spectral_whole", f"""WITH f AS (SELECT user_id, value AS x, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS tt, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    w AS (SELECT *, unnest(range(0, CAST(n // 2 + 1 AS BIGINT))) AS k FROM f),
    m AS (SELECT user_id, k, sqrt(sum(x * cos(2 * pi() * (k * tt % n) / n)) ^ 2 + sum(x * sin(2 * pi() * (k * tt % n) / n)) ^ 2) AS mag FROM w GROUP BY ALL),
    d AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY round(mag, 6) DESC, k) AS rn FROM m WHERE k > 0)
    SELECT m.user_id, {r6('max(d.k)')} AS dominant, {r6('sum(mag ^ 2)', 3)} AS energy, {r6('coalesce(sum(mag) FILTER (m.k >= 30), 0) / (sum(mag) + 1e-10)')} AS high_share
    FROM m LEFT JOIN d ON m.user_id = d.user_id AND d.rn = 1 GROUP BY 1""")
def spectral_whole(t):
    e = t.events.withColumn("clock", F.unix_micros(F.col("ts").cast("timestamp")))
    s = agg.spectral_features(e, ["user_id"], "clock", "event_id", "value")
    return s.select("user_id", rnd("dominant").alias("dominant"), rnd("energy", 3).alias("energy"), rnd("high_share").alias("high_share"))


@query("linear_detrend", f"""WITH m AS (SELECT extract(year FROM o_orderdate) AS y, avg(o_totalprice) AS m FROM orders GROUP BY 1), l AS (SELECT regr_slope(m, y) AS b, regr_intercept(m, y) AS a FROM m)
    SELECT o_orderkey, {r6('o_totalprice - (a + b * extract(year FROM o_orderdate))', 2)} AS detrended FROM orders, l""")
def linear_detrend(t):
    o = t.orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    return agg.detrend(o, "y", "o_totalprice").select("o_orderkey", rnd("detrended", 2).alias("detrended"))


_TAGS = "list_distinct(list_filter([CASE WHEN y = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, 'lang_' || lang, source], lambda v: v IS NOT NULL))"


@query("tag_cooccurrence", f"""WITH g AS (SELECT doc_id, unnest({_TAGS}) AS tag FROM v_text), n AS (SELECT tag, count(*) AS n FROM g GROUP BY 1), c AS (SELECT count(DISTINCT doc_id) AS c FROM g),
    p AS (SELECT x.tag AS a, z.tag AS b, count(*) AS n_ab FROM g x JOIN g z ON x.doc_id = z.doc_id AND x.tag < z.tag GROUP BY 1, 2)
    SELECT a, b, n_ab, {r6('n_ab * c / (na.n * nb.n)')} AS lift FROM p JOIN n na ON a = na.tag JOIN n nb ON b = nb.tag, c""")
def tag_cooccurrence(t):
    d = view(t, "v_text").select("doc_id", tags().alias("tags"))
    return agg.cooccurrence(d, "doc_id", "tags").select("a", "b", "n_ab", rnd("lift").alias("lift"))


def tags():
    return F.array_compact(F.array(F.when(F.col("y") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.concat(F.lit("lang_"), "lang"), F.col("source")))


_VOTES = "SELECT event_id, unnest([CAST(value > 20 AS INT), CAST(event_type IN ('click', 'purchase') AS INT), CAST(user_id % 2 AS INT)]) AS vote FROM events"


@query("annotator_majority", f"""WITH v AS ({_VOTES}), s AS (SELECT event_id, sum(vote) AS ones, count(*) AS k FROM v GROUP BY 1)
    SELECT event_id, CAST(ones * 2 > k AS INT) AS label, {r6('CASE WHEN ones IN (0, k) THEN 0 ELSE -(ones / k) * ln(ones / k) - (1 - ones / k) * ln(1 - ones / k) END')} AS disagreement FROM s""")
def annotator_majority(t):
    v = t.events.select("event_id", F.explode(F.array(flag(F.col("value") > 20), flag(F.col("event_type").isin("click", "purchase")), (F.col("user_id") % 2).cast("int"))).alias("vote"))
    s = v.groupBy("event_id").agg(F.avg("vote").alias("p"))
    h = F.when(F.col("p").isin(0.0, 1.0), 0.0).otherwise(-F.col("p") * F.ln("p") - (1 - F.col("p")) * F.ln(1 - F.col("p")))
    return s.select("event_id", flag(F.col("p") > 0.5).alias("label"), rnd(h).alias("disagreement"))


@query("group_entropy", f"""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
    SELECT user_id, {r6('-sum(p * ln(p))')} AS entropy, count(*) AS n_values FROM p GROUP BY 1""")
def group_entropy(t):
    return agg.entropy(t.events, ["user_id"], "event_type").select("user_id", rnd("entropy").alias("entropy"), "n_values")


@query("share_drift", f"""WITH c AS (SELECT extract(year FROM o_orderdate) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY y) AS share FROM c)
    SELECT CAST(y AS INT) AS y, o_orderstatus, {r6('share')} AS share, {r6('share - lag(share) OVER (PARTITION BY o_orderstatus ORDER BY y)')} AS change FROM s""")
def share_drift(t):
    c = t.orders.groupBy(F.year("o_orderdate").alias("y"), "o_orderstatus").count()
    total = c.groupBy("y").agg(F.sum("count").alias("total"))
    s = c.join(total, "y").withColumn("share", F.col("count") / F.col("total"))
    past = F.lag("share").over(W.partitionBy("o_orderstatus").orderBy("y"))
    return s.select("y", "o_orderstatus", rnd("share").alias("share"), rnd(F.col("share") - past).alias("change"))


@query("response_rate", f"SELECT c_mktsegment, count(*) AS asked, {r6('avg(CAST(EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP ' + chr(39) + '2001-01-01' + chr(39) + ') AS INT))')} AS rate FROM customer GROUP BY 1")
def response_rate(t):
    did = t.orders.filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(1))
    return t.customer.join(did, "c_custkey", "left").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("asked"), rnd(F.avg(F.coalesce("hit", F.lit(0)))).alias("rate"))


@query("shrink_to_group", f"""WITH o AS (SELECT l_returnflag AS g, l_suppkey AS u, count(*) AS n, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2), g AS (SELECT l_returnflag AS g, avg(l_extendedprice) AS gm FROM lineitem GROUP BY 1)
    SELECT o.g AS l_returnflag, u AS l_suppkey, n, {r6('(n * m + 20 * gm) / (n + 20)', 3)} AS shrunk FROM o JOIN g USING (g)""")
def shrink_to_group(t):
    return agg.shrink(t.lineitem, "l_suppkey", "l_returnflag", "l_extendedprice", 20).select("l_returnflag", "l_suppkey", "n", rnd("shrunk", 3).alias("shrunk"))


@query("level_contrast", f"""WITH m AS (SELECT seg, avg(x1) AS mx, avg(y) AS my FROM v_reg GROUP BY 1), d AS (SELECT x1 - mx AS dx, y - my AS dy FROM v_reg JOIN m USING (seg))
    SELECT (SELECT {r6('regr_slope(dy, dx)', 3)} FROM d) AS within_slope, (SELECT {r6('regr_slope(my, mx)', 3)} FROM m) AS between_slope, (SELECT {r6('regr_slope(y, x1)', 3)} FROM v_reg) AS pooled_slope""")
def level_contrast(t):
    r = view(t, "v_reg").select("seg", "x1", "y")
    rows = group_values(r, ["seg"], {"mx": F.avg("x1"), "my": F.avg("y")})
    inside = rows.agg(F.regr_slope(F.col("y") - F.col("my"), F.col("x1") - F.col("mx")).alias("w"), F.regr_slope("y", "x1").alias("p"))
    between = r.groupBy("seg").agg(F.avg("x1").alias("mx"), F.avg("y").alias("my")).agg(F.regr_slope("my", "mx")).scalar()
    return inside.select(rnd("w", 3).alias("within_slope"), rnd(between, 3).alias("between_slope"), rnd("p", 3).alias("pooled_slope"))


@query("price_elasticity", f"SELECT l_returnflag, l_linestatus, {r6('regr_slope(ln(l_quantity), ln(l_extendedprice))')} AS elasticity, count(*) AS n FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1, 2")
def price_elasticity(t):
    li = t.lineitem.filter("l_quantity > 0 AND l_extendedprice > 0")
    return li.groupBy("l_returnflag", "l_linestatus").agg(rnd(F.regr_slope(F.ln("l_quantity"), F.ln("l_extendedprice"))).alias("elasticity"), F.count(F.lit(1)).alias("n"))


@query("croston", f"""WITH d AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS u FROM events GROUP BY 1, 2),
    g AS (SELECT user_id, unnest(range((SELECT min(day) FROM d), (SELECT max(day) + 1 FROM d))) AS day FROM (SELECT DISTINCT user_id FROM events)),
    h AS (SELECT g.user_id, g.day, coalesce(u, 0) AS u FROM g LEFT JOIN d ON g.user_id = d.user_id AND g.day = d.day),
    p AS (SELECT user_id, u, row_number() OVER w - 1 AS i, lead(day) OVER w - day AS gap, count(*) OVER (PARTITION BY user_id) AS n FROM h WHERE u > 0 WINDOW w AS (PARTITION BY user_id ORDER BY day)),
    s AS (SELECT user_id, sum(CASE WHEN i = 0 THEN 1 ELSE 0.1 END * power(0.9::DOUBLE, n - 2 - i) * u) / sum(CASE WHEN i = 0 THEN 1 ELSE 0.1 END * power(0.9::DOUBLE, n - 2 - i) * gap) AS f FROM p WHERE gap IS NOT NULL GROUP BY 1),
    m AS (SELECT user_id, avg(u) AS m, CAST(sum(CAST(u > 0 AS INT)) AS BIGINT) AS n_demand FROM h GROUP BY 1)
    SELECT m.user_id, n_demand, {r6('coalesce(f, m)')} AS forecast FROM m LEFT JOIN s USING (user_id)""")
def croston(t):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    d = t.events.groupBy("user_id", day.alias("day")).agg(F.sum(flag(F.col("event_type") == "purchase")).alias("u"))
    return agg.croston(densify(d, ["user_id"], "day", {"u": 0}), ["user_id"], "day", "u").select("user_id", "n_demand", rnd("forecast").alias("forecast"))
