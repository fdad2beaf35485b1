"""Projections, filters and predicates."""

from pyspark.sql import Window as W, functions as F

from larkspur.functions.scalar import bins, flag, ladder, ratio, rnd
from larkspur.operators import clean
from larkspur.operators.windows import group_values
from larkspur.plans.registry import query, r6
from larkspur.plans.views import view

# Label order of the quality scale and of the order priorities
QUALITY_RANK = {"None": 0, "Po": 1, "Fa": 2, "TA": 3, "Gd": 4, "Ex": 5}
PRIORITY_RANK = {"5-LOW": 1, "4-NOT SPECIFIED": 2, "3-MEDIUM": 3, "2-HIGH": 4, "1-URGENT": 5}
# Month to season
SEASONS = {12: "Winter", 1: "Winter", 2: "Winter", 3: "Spring", 4: "Spring", 5: "Spring",
           6: "Summer", 7: "Summer", 8: "Summer", 9: "Fall", 10: "Fall", 11: "Fall"}
# Bin edges and points of the early-warning score (respiratory rate, heart rate)
RESP_EDGES, RESP_POINTS = [-1, 8, 14, 20, 30, 100], [2, 0, 1, 2, 3]
HEART_EDGES, HEART_POINTS = [-1, 40, 50, 100, 110, 130, 250], [2, 1, 0, 1, 2, 3]
# Age groups
AGE_EDGES, AGE_LABELS = [0, 12, 18, 35, 60, 100], ["Child", "Teen", "Adult", "Middle", "Senior"]


@query("scan_table", f"SELECT event_id, user_id, {r6('value')} AS value FROM events WHERE event_type = 'purchase' AND value > 50")
def scan_table(t):
    from larkspur.sources.tables import nan_to_null
    e = t.events.select("event_id", "user_id", "event_type", "value")
    e = e.filter((F.col("event_type") == "purchase") & (F.col("value") > 50))
    return nan_to_null(e).select("event_id", "user_id", rnd("value").alias("value"))


@query("drop_columns", "SELECT user_id, event_type, value FROM v_gap")
def drop_columns(t):
    wide = view(t, "v_gap").withColumns({
        "constant": F.lit(1), "sparse": F.when(F.col("event_id") % 3 == 0, F.col("value"))})
    return clean.drop_columns(wide, ids=["event_id", "ts"])


@query("missing_flag", "SELECT event_id, CAST(value IS NULL AS INT) AS value_missing, coalesce(value, 0.0::DOUBLE) AS value FROM v_gap")
def missing_flag(t):
    d = view(t, "v_gap").select("event_id", "value")
    return clean.missing_flags(d, ["value"]).fillna({"value": 0.0})


@query("ratio_features", f"""SELECT l_orderkey, l_linenumber, {r6('l_extendedprice / nullif(l_quantity, 0)')} AS unit_price,
    {r6('l_quantity / (l_linenumber + 1)')} AS qty_per_line, {r6('l_extendedprice / (l_quantity + 0.01::DOUBLE)')} AS price_vs_qty,
    {r6('l_extendedprice * (1 - l_discount) * (1 + l_tax)')} AS charge, {r6('l_discount + l_tax')} AS rate_sum,
    {r6('l_discount * l_tax')} AS rate_product FROM lineitem""")
def ratio_features(t):
    p, q, d, x = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", rnd(ratio(p, q)).alias("unit_price"),
        rnd(q / (F.col("l_linenumber") + 1)).alias("qty_per_line"), rnd(p / (q + 0.01)).alias("price_vs_qty"),
        rnd(p * (1 - d) * (1 + x)).alias("charge"), rnd(d + x).alias("rate_sum"), rnd(d * x).alias("rate_product"))


@query("flag_features", """SELECT event_id, CAST(value > 50 AS INT) AS high_value, CAST(event_type IN ('click', 'view') AS INT) AS passive,
    CAST(value BETWEEN 10 AND 20 AS INT) AS mid_value, CAST(extract(hour FROM ts) BETWEEN 0 AND 5 AS INT) AS is_night,
    CAST(extract(hour FROM ts) BETWEEN 0 AND 5 AS INT) * CAST(event_type = 'purchase' AS INT) AS night_purchase FROM events""")
def flag_features(t):
    night, buy = F.hour("ts").between(0, 5), F.col("event_type") == "purchase"
    return t.events.select(
        "event_id", flag(F.col("value") > 50).alias("high_value"), flag(F.col("event_type").isin("click", "view")).alias("passive"),
        flag(F.col("value").between(10, 20)).alias("mid_value"), flag(night).alias("is_night"), (flag(night) * flag(buy)).alias("night_purchase"))


@query("composite_score", """SELECT o_orderkey, CAST(o_totalprice > 400000 AS INT) * 2 + CAST(o_orderstatus = 'P' AS INT)
    + CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INT) * 2 + CAST(extract(month FROM o_orderdate) = 12 AS INT) AS score FROM orders""")
def composite_score(t):
    return t.orders.select("o_orderkey", (
        flag(F.col("o_totalprice") > 400000) * 2 + flag(F.col("o_orderstatus") == "P")
        + flag(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")) * 2 + flag(F.month("o_orderdate") == 12)).alias("score"))


@query("rfm_features", f"""SELECT o_custkey, date_diff('day', max(o_orderdate)::DATE, DATE '2001-01-01') AS recency,
    count(*) AS frequency, {r6('sum(o_totalprice)', 2)} AS monetary, {r6('avg(o_totalprice)', 4)} AS avg_order
    FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY o_custkey""")
def rfm_features(t):
    o = t.orders.filter(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz"))
    return o.groupBy("o_custkey").agg(
        F.datediff(F.lit("2001-01-01").cast("date"), F.max("o_orderdate").cast("date")).cast("bigint").alias("recency"),
        F.count(F.lit(1)).alias("frequency"), rnd(F.sum("o_totalprice"), 2).alias("monetary"), rnd(F.avg("o_totalprice"), 4).alias("avg_order"))


@query("ordinal_map", """SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '3-MEDIUM' THEN 3
    WHEN '2-HIGH' THEN 4 WHEN '1-URGENT' THEN 5 ELSE 0 END AS priority_rank,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS status_rank FROM orders""")
def ordinal_map(t):
    def ranked(c, ranks):
        m = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
        return F.coalesce(F.try_element_at(m, F.col(c)), F.lit(0))
    return t.orders.select("o_orderkey", ranked("o_orderpriority", PRIORITY_RANK).alias("priority_rank"),
                           ranked("o_orderstatus", {"F": 1, "O": 2}).alias("status_rank"))


@query("remap_values", """SELECT o_orderkey, CASE WHEN extract(month FROM o_orderdate) IN (12, 1, 2) THEN 'Winter'
    WHEN extract(month FROM o_orderdate) IN (3, 4, 5) THEN 'Spring' WHEN extract(month FROM o_orderdate) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'rush' ELSE o_orderpriority END AS merged FROM orders""")
def remap_values(t):
    season = F.create_map(*[F.lit(x) for kv in SEASONS.items() for x in kv])
    o = t.orders.select("o_orderkey", season[F.month("o_orderdate")].alias("season"), F.col("o_orderpriority").alias("merged"))
    return o.replace({"1-URGENT": "rush", "2-HIGH": "rush"}, subset=["merged"])


@query("top_n_other", """WITH top AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10)
    SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE 'Other' END AS p_brand FROM part""")
def top_n_other(t):
    return clean.top_n_other(t.part.select("p_partkey", "p_brand"), "p_brand", 10)


@query("cross_feature", "SELECT p_partkey, concat_ws('_', p_brand, p_type) AS brand_type, concat_ws('|', p_brand, p_type, CAST(p_size AS VARCHAR)) AS brand_type_size FROM part")
def cross_feature(t):
    return t.part.select("p_partkey", F.concat_ws("_", "p_brand", "p_type").alias("brand_type"),
                         F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")).alias("brand_type_size"))


@query("fixed_bins", """SELECT p_partkey, CASE WHEN p_size <= 0 THEN NULL WHEN p_size <= 12 THEN 'Child' WHEN p_size <= 18 THEN 'Teen'
    WHEN p_size <= 35 THEN 'Adult' WHEN p_size <= 60 THEN 'Middle' WHEN p_size <= 100 THEN 'Senior' END AS size_group,
    CASE WHEN p_size <= 8 THEN 2 WHEN p_size <= 14 THEN 0 WHEN p_size <= 20 THEN 1 WHEN p_size <= 30 THEN 2 ELSE 3 END
    + CASE WHEN p_size * 3 <= 40 THEN 2 WHEN p_size * 3 <= 50 THEN 1 WHEN p_size * 3 <= 100 THEN 0 WHEN p_size * 3 <= 110 THEN 1 WHEN p_size * 3 <= 130 THEN 2 ELSE 3 END
    AS warning_score FROM part""")
def fixed_bins(t):
    score = bins("p_size", RESP_EDGES, RESP_POINTS) + bins(F.col("p_size") * 3, HEART_EDGES, HEART_POINTS)
    return t.part.select("p_partkey", bins("p_size", AGE_EDGES, AGE_LABELS).alias("size_group"), score.alias("warning_score"))


@query("quantile_bins", """WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS edges FROM orders)
    SELECT o_orderkey, CAST(len(list_filter(edges[2:len(edges)-1], lambda x: x < o_totalprice)) AS INT) AS decile FROM orders, e""")
def quantile_bins(t):
    return clean.quantile_bins(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 10, "decile").select("o_orderkey", "decile")


@query("decision_bands", """WITH s AS (SELECT id, score, CAST(round(1000 * (1 - score)) AS INT) AS risk_score FROM v_scores)
    SELECT id, risk_score, CASE WHEN risk_score >= 800 THEN 'auto_approve' WHEN risk_score >= 700 THEN 'risk_priced' WHEN risk_score >= 600 THEN 'conditional' ELSE 'decline' END AS band,
    CASE WHEN score * 250 > 200 THEN 'CRITICAL' WHEN score * 250 > 150 THEN 'WARNING' WHEN score * 250 > 100 THEN 'WATCH' ELSE 'NORMAL' END AS alert FROM s""")
def decision_bands(t):
    level = F.col("score") * 250
    alert = F.when(level > 200, "CRITICAL").when(level > 150, "WARNING").when(level > 100, "WATCH").otherwise("NORMAL")
    s = view(t, "v_scores").select("id", F.round(1000 * (1 - F.col("score"))).cast("int").alias("risk_score"), alert.alias("alert"))
    return s.withColumn("band", ladder("risk_score", [(800, "auto_approve"), (700, "risk_priced"), (600, "conditional")], "decline"))


@query("cost_aware_round", """SELECT id, CAST(least(greatest(CASE WHEN score * 5 >= 3.4 THEN ceil(score * 5) ELSE round_even(score * 5, 0) END, 0), 4) AS INT) AS cls FROM v_scores""")
def cost_aware_round(t):
    p = F.col("score") * 5
    cls = F.when(p >= 3.4, F.ceil(p)).otherwise(F.bround(p))
    return view(t, "v_scores").select("id", F.least(F.greatest(cls, F.lit(0)), F.lit(4)).cast("int").alias("cls"))


@query("log_transform", f"""WITH s AS (SELECT abs(skewness(value)) > 0.75 AS skewed FROM events)
    SELECT event_id, {r6('CASE WHEN skewed THEN ln(1 + value) ELSE value END')} AS value, {r6('exp(ln(1 + value)) - 1')} AS back FROM events, s""")
def log_transform(t):
    e = t.events.select("event_id", "value")
    skewed = e.agg((F.abs(clean.corrected_skew("value")) > 0.75).alias("s")).scalar()
    return e.select("event_id", rnd(F.when(skewed, F.log1p("value")).otherwise(F.col("value"))).alias("value"),
                    rnd(F.expm1(F.log1p("value"))).alias("back"))


@query("logit_transform", f"""WITH s AS (SELECT id, least(greatest(score, 1e-6), 1 - 1e-6) AS p FROM v_scores)
    SELECT id, {r6('ln(p / (1 - p))')} AS logit, {r6('1 / (1 + exp(-ln(p / (1 - p))))')} AS back FROM s""")
def logit_transform(t):
    p = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
    s = view(t, "v_scores").select("id", F.ln(p / (1 - p)).alias("logit"))
    return s.select("id", rnd("logit").alias("logit"), rnd(1 / (1 + F.exp(-F.col("logit")))).alias("back"))


@query("power_features", f"""SELECT p_partkey, {r6('p_size ^ 2')} AS size_sq, {r6('p_size ^ 3')} AS size_cu, {r6('greatest(p_size - 30, 0)')} AS above,
    {r6('greatest(20 - p_size, 0)')} AS below, {r6('greatest(p_size - 30, 0) ^ 2')} AS above_sq FROM part""")
def power_features(t):
    s = F.col("p_size")
    over = F.greatest(s - 30, F.lit(0))
    return t.part.select("p_partkey", rnd(F.pow(s, 2)).alias("size_sq"), rnd(F.pow(s, 3)).alias("size_cu"), rnd(over).alias("above"),
                         rnd(F.greatest(20 - s, F.lit(0))).alias("below"), rnd(F.pow(over, 2)).alias("above_sq"))


@query("polynomial_features", f"""SELECT l_orderkey, l_linenumber, {r6('x1')} AS x1, {r6('x2')} AS x2, {r6('x1 * x1')} AS x1_x1,
    {r6('x1 * x2')} AS x1_x2, {r6('x2 * x2')} AS x2_x2 FROM v_reg""")
def polynomial_features(t):
    terms = clean.polynomial(["x1", "x2"], 2)
    return view(t, "v_reg").select("l_orderkey", "l_linenumber", *[rnd(c).alias(n) for n, c in terms.items()])


@query("filter_outliers", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity > 45 AND l_extendedprice < 60000) AND l_discount BETWEEN 0.01 AND 0.09")
def filter_outliers(t):
    bad = (F.col("l_quantity") > 45) & (F.col("l_extendedprice") < 60000)
    return t.lineitem.filter(~bad & F.col("l_discount").between(0.01, 0.09)).select("l_orderkey", "l_linenumber")


@query("group_filter", """WITH m AS (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY o_custkey),
    b AS (SELECT o.o_custkey FROM orders o JOIN m USING (o_custkey) GROUP BY o.o_custkey HAVING max(abs(o_totalprice - m)) <= 200000)
    SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM b)""")
def group_filter(t):
    o = group_values(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], {"m": F.avg("o_totalprice")})
    return clean.group_filter(o, ["o_custkey"], F.abs(F.col("o_totalprice") - F.col("m")) > 200000).select("o_orderkey")


@query("dedupe_rows", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE)::VARCHAR AS d FROM events")
def dedupe_rows(t):
    return t.events.select("user_id", "event_type", F.to_date("ts").cast("string").alias("d")).dropDuplicates()


@query("dedupe_subset", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) rn FROM events) WHERE rn = 1")
def dedupe_subset(t):
    e = t.events.select("event_id", "user_id", "event_type", "ts")
    return clean.dedupe_subset(e, ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("clip_range", f"SELECT event_id, {r6('least(greatest(value, 5), 100)')} AS value FROM events")
def clip_range(t):
    return t.events.select("event_id", rnd(F.least(F.greatest("value", F.lit(5.0)), F.lit(100.0))).alias("value"))


@query("cap_iqr", f"""WITH q AS (SELECT quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.25) AS q1 FROM events)
    SELECT event_id, {r6('least(value, q3 + 3 * (q3 - q1))')} AS value FROM events, q""")
def cap_iqr(t):
    return clean.cap_iqr(t.events.select("event_id", "value"), "value").select("event_id", rnd("value").alias("value"))


@query("cap_quantile", f"""WITH q AS (SELECT quantile_cont(value, 0.99) AS hi, quantile_cont(value, 0.005) AS lo FROM events)
    SELECT event_id, {r6('greatest(least(value, hi), lo)')} AS winsorised, {r6('least(value, hi * 1.5)')} AS capped FROM events, q""")
def cap_quantile(t):
    e = t.events.select("event_id", F.col("value").alias("winsorised"), F.col("value").alias("capped"))
    e = clean.cap_quantile(clean.cap_quantile(e, "winsorised", 0.99, 0.005), "capped", 0.99, factor=1.5)
    return e.select("event_id", rnd("winsorised").alias("winsorised"), rnd("capped").alias("capped"))


@query("array_features", f"""WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 40 + 60) AS hi, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 40 + 45) AS lo FROM embeddings)
    SELECT vec_id, {r6('list_sum(list_transform(list_zip(hi, lo), lambda z: greatest((least(z[1], 86) + greatest(z[2], 50)) / 2 - 50, 0)))')} AS degree_days,
    CAST(len(list_filter(hi, lambda x: x > 95)) AS INT) AS hot_days, {r6('list_sum(hi)', 4)} AS total FROM a""")
def array_features(t):
    e = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 40 + 60).alias("hi"),
                            F.transform("embedding", lambda x: x.cast("double") * 40 + 45).alias("lo"))
    day = F.zip_with("hi", "lo", lambda h, l: F.greatest((F.least(h, F.lit(86.0)) + F.greatest(l, F.lit(50.0))) / 2 - 50, F.lit(0.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", rnd(total(day)).alias("degree_days"), F.size(F.filter("hi", lambda x: x > 95)).alias("hot_days"),
                    rnd(total(F.col("hi")), 4).alias("total"))


@query("row_extremes", f"SELECT l_orderkey, l_linenumber, {r6('greatest(l_discount, l_tax)')} AS hi, {r6('least(l_discount, l_tax)')} AS lo, {r6('l_discount - l_tax')} AS diff FROM lineitem")
def row_extremes(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", rnd(F.greatest("l_discount", "l_tax")).alias("hi"),
                             rnd(F.least("l_discount", "l_tax")).alias("lo"), rnd(F.col("l_discount") - F.col("l_tax")).alias("diff"))


@query("capacity_clip", f"""SELECT o.o_orderkey, {r6('least(o.o_totalprice, c.c_acctbal * 50)')} AS capped FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def capacity_clip(t):
    cap = t.customer.select("c_custkey", (F.col("c_acctbal") * 50).alias("ceiling"))
    return t.orders.join(cap, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", rnd(F.least("o_totalprice", "ceiling")).alias("capped"))


@query("deflate_by_index", f"""WITH idx AS (SELECT extract(year FROM o_orderdate) AS y, avg(o_totalprice) AS level FROM orders GROUP BY 1),
    base AS (SELECT level AS b FROM idx WHERE y = 1995)
    SELECT o_orderkey, {r6('o_totalprice * b / level', 3)} AS real_price FROM orders JOIN idx ON extract(year FROM o_orderdate) = y, base""")
def deflate_by_index(t):
    o = t.orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    index = o.groupBy("y").agg(F.avg("o_totalprice").alias("level"))
    base = index.filter("y = 1995").select("level").scalar()
    return o.join(index, "y").select("o_orderkey", rnd(F.col("o_totalprice") * base / F.col("level"), 3).alias("real_price"))
