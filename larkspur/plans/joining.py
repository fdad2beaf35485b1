"""Lookups, as-of, interval, spatial and set joins."""

from pyspark.sql import Window as W, functions as F

from larkspur.functions.scalar import flag, haversine_km, rnd
from larkspur.operators import joins
from larkspur.operators.neighbors import knn
from larkspur.operators.prefix import exact_quantiles
from larkspur.plans.registry import mix, query, r6
from larkspur.plans.series import events
from larkspur.plans.views import view

HOUR_US = 3_600_000_000


@query("lookup_join", f"SELECT o_orderkey, coalesce(c_mktsegment, 'UNKNOWN') AS segment, {r6('coalesce(c_acctbal, 0)')} AS acctbal FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def lookup_join(t):
    dim = t.customer.filter("c_acctbal > 0").select("c_custkey", "c_mktsegment", "c_acctbal")
    return t.orders.join(dim, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "o_orderkey", F.coalesce("c_mktsegment", F.lit("UNKNOWN")).alias("segment"), rnd(F.coalesce("c_acctbal", F.lit(0.0))).alias("acctbal"))


@query("child_count_join", "SELECT o.o_orderkey, coalesce(n, 1) AS n_lines, coalesce(r, 0) AS n_returned FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(l_returnflag = 'R' AS INT)) AS BIGINT) AS r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def child_count_join(t):
    c = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(flag(F.col("l_returnflag") == "R")).alias("r"))
    return t.orders.select("o_orderkey").join(c, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", F.coalesce("n", F.lit(1)).alias("n_lines"), F.coalesce("r", F.lit(0)).alias("n_returned"))


_KINDS = ["click", "purchase", "error"]


@query("first_event_pivot", "SELECT user_id, " + ", ".join(f"{r6(f'arg_min(value, ts) FILTER (event_type = {chr(39)}{k}{chr(39)})')} AS first_{k}, CAST(count(*) FILTER (event_type = '{k}') = 0 AS INT) AS {k}_missing" for k in _KINDS) + " FROM events GROUP BY 1")
def first_event_pivot(t):
    p = t.events.groupBy("user_id").pivot("event_type", _KINDS).agg(F.min_by("value", F.struct("ts", "event_id")))
    return p.select("user_id", *[rnd(k).alias(f"first_{k}") for k in _KINDS], *[F.col(k).isNull().cast("int").alias(f"{k}_missing") for k in _KINDS])


_PREFIX = {"has_red": ["red"], "has_small_blue": ["small", "blue"], "has_b": ["b"]}


@query("prefix_flags", "SELECT l_orderkey, " + ", ".join(f"CAST(max(CAST({' OR '.join(f'starts_with(p_name, {chr(39)}{p}{chr(39)})' for p in ps)} AS INT)) AS INT) AS {n}" for n, ps in _PREFIX.items()) + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def prefix_flags(t):
    codes = t.part.select("p_partkey", *[flag(F.coalesce(*[F.when(F.col("p_name").startswith(p), True) for p in ps])).alias(n) for n, ps in _PREFIX.items()])
    return t.lineitem.select("l_orderkey", "l_partkey").join(codes, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(*[F.max(n).alias(n) for n in _PREFIX])


@query("asof_join", f"""WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
    SELECT q.event_id, {r6('CASE WHEN epoch_us(q.ts) - epoch_us(r.ts) <= 172800000000 THEN r.value END')} AS ref FROM q ASOF LEFT JOIN r ON q.user_id = r.user_id AND q.ts >= r.ts""")
def asof_join(t):
    e = events(t)
    q, r = e.filter("event_type = 'click'"), e.filter("event_type = 'view'")
    return joins.asof(q, r, ["user_id"], "clock", "clock", ["value"], tolerance=48 * HOUR_US).select("event_id", rnd("r_value").alias("ref"))


_CAL = """WITH e AS (SELECT *, user_id % 23 AS station FROM events), q AS (SELECT * FROM e WHERE event_type = 'click'), r AS (SELECT station, ts, value FROM e WHERE event_type = 'view'),
    p AS (SELECT q.station, q.value AS x, CASE WHEN epoch_us(q.ts) - epoch_us(r.ts) <= 172800000000 THEN r.value END AS y FROM q ASOF LEFT JOIN r ON q.station = r.station AND q.ts >= r.ts)"""


@query("sensor_calibration", f"""{_CAL} SELECT station, count(y) AS n_pairs, {r6('CASE WHEN count(y) >= 100 THEN regr_slope(y, x) ELSE 1 END')} AS slope, {r6('CASE WHEN count(y) >= 100 THEN regr_intercept(y, x) ELSE 0 END')} AS "offset" FROM p GROUP BY 1""")
def sensor_calibration(t):
    """Each station's click readings against its latest view reading of the last 48 hours."""
    e = events(t).withColumn("station", F.col("user_id") % 23)
    c = joins.calibrate(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), ["station"], "clock", "value", "value", 48 * HOUR_US)
    return c.select("station", "n_pairs", rnd("slope").alias("slope"), rnd("offset").alias("offset"))


@query("point_in_time_join", f"""SELECT o.o_orderkey, {r6('r.o_totalprice', 2)} AS prior_price FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') o ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_totalprice) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) r
    ON o.o_custkey = r.o_custkey AND o.o_orderdate >= r.o_orderdate""")
def point_in_time_join(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.unix_date(F.to_date("o_orderdate")).alias("day"))
    filed = o.filter("o_orderstatus = 'F'").groupBy("o_custkey", "day").agg(F.max("o_totalprice").alias("price"))
    return joins.asof(o.filter("o_orderstatus = 'O'"), filed, ["o_custkey"], "day", "day", ["price"]).select("o_orderkey", rnd("r_price", 2).alias("prior_price"))


def failures(t):
    return view(t, "v_fail").select(F.col("asset_id").alias("user_id"), F.unix_micros(F.col("failure_ts").cast("timestamp")).alias("at"))


@query("range_label_join", "SELECT event_id, CAST(EXISTS (SELECT 1 FROM v_fail f WHERE f.asset_id = e.user_id AND e.ts >= f.failure_ts - INTERVAL 24 HOUR AND e.ts < f.failure_ts) AS INT) AS label FROM events e")
def range_label_join(t):
    return joins.label_ahead(events(t), failures(t), ["user_id"], "clock", "at", 24 * HOUR_US).select("event_id", "label")


@query("range_exclude", "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM v_fail f WHERE f.asset_id = e.user_id AND e.ts > f.failure_ts AND e.ts <= f.failure_ts + INTERVAL 48 HOUR)")
def range_exclude(t):
    return joins.exclude_after(events(t), failures(t), ["user_id"], "clock", "at", 48 * HOUR_US).select("event_id")


@query("lead_time", f"""WITH p AS (SELECT f.asset_id, f.failure_ts, epoch_us(f.failure_ts) - min(epoch_us(e.ts)) AS lead FROM v_fail f JOIN events e ON e.user_id = f.asset_id AND e.value > 20 AND e.ts >= f.failure_ts - INTERVAL 24 HOUR AND e.ts < f.failure_ts GROUP BY 1, 2),
    h AS (SELECT lead / 3600000000.0::DOUBLE AS h FROM p) SELECT count(*) AS n, {r6('avg(h)')} AS mean_h, {r6('quantile_cont(h, .5)')} AS p50_h, {r6('quantile_cont(h, .9)')} AS p90_h FROM h""")
def lead_time(t):
    flags = events(t).filter("value > 20").select("user_id", "clock")
    lead = joins.first_flag_before(failures(t), flags, ["user_id"], "at", "clock", 24 * HOUR_US).filter("lead IS NOT NULL").select((F.col("lead") / F.lit(float(HOUR_US))).alias("h"))
    q = exact_quantiles(lead, "h", {"p50": .5, "p90": .9})
    s = lead.agg(F.count(F.lit(1)).alias("n"), F.avg("h").alias("mean"))
    from larkspur.operators.clean import attach_one
    return attach_one(s, q).select("n", rnd("mean").alias("mean_h"), rnd("p50").alias("p50_h"), rnd("p90").alias("p90_h"))


_NATION = "p AS (SELECT c_nationkey AS src, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS m, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


@query("adjacency_lag_join", f"WITH {_NATION} SELECT a.src, a.m, {r6('avg(b.v)', 2)} AS neighbour_mean FROM p a LEFT JOIN v_edge e ON e.src = a.src LEFT JOIN p b ON b.src = e.dst AND b.m = a.m - 1 GROUP BY 1, 2")
def adjacency_lag_join(t):
    o = t.orders.select("o_custkey", "o_totalprice", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m"))
    p = o.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey")).groupBy("src", "m").agg(F.sum("o_totalprice").alias("v"))
    return joins.neighbour_lag(p, view(t, "v_edge"), "src", "m", "v", 1).select("src", "m", rnd("neighbour_mean", 2).alias("neighbour_mean"))


def _hav(a, b):
    return f"2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


@query("haversine", f"SELECT a.id, {r6(_hav('a', 'b'), 4)} AS km FROM v_place a JOIN v_poi b ON b.poi_id = a.id % 10")
def haversine(t):
    a, b = view(t, "v_place"), view(t, "v_poi").withColumnsRenamed({"lat": "lat2", "lon": "lon2"})
    return a.join(b, F.col("id") % 10 == F.col("poi_id")).select("id", rnd(haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 4).alias("km"))


@query("radius_join", f"""WITH d AS (SELECT a.id, b.id AS other, b.value, {_hav('a', 'b')} AS km FROM v_place a JOIN v_place b ON a.id <> b.id), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, other) AS rn FROM d WHERE km <= 15)
    SELECT id, count(*) AS n, {r6('avg(value)')} AS mean, {r6('max(value)')} AS "max", {r6('stddev_samp(value)')} AS std FROM n WHERE rn <= 8 GROUP BY 1""")
def radius_join(t):
    p = view(t, "v_place")
    hits = joins.geo_nearest(p, p, "id", "id", 8, radius_km=15, rule="not_self")
    v = hits.join(p.select(F.col("id").alias("bid"), "value"), "bid")
    return v.groupBy(F.col("qid").alias("id")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("value")).alias("mean"), rnd(F.max("value")).alias("max"), rnd(F.stddev_samp("value")).alias("std"))


@query("nearest_distance", f"SELECT a.id, {r6('min(' + _hav('a', 'b') + ')', 4)} AS km FROM v_place a, v_poi b GROUP BY 1")
def nearest_distance(t):
    return joins.geo_nearest(view(t, "v_place"), view(t, "v_poi"), "id", "poi_id", 1).select(F.col("qid").alias("id"), rnd("km", 4).alias("km"))


@query("spatial_knn_mean", f"""WITH d AS (SELECT a.id, b.value, row_number() OVER (PARTITION BY a.id ORDER BY {_hav('a', 'b')}, b.id) AS rn FROM v_place a JOIN v_place b ON b.id < a.id) SELECT id, {r6('avg(value)')} AS mean_5 FROM d WHERE rn <= 5 GROUP BY 1""")
def spatial_knn_mean(t):
    """Mean price of the five nearest earlier sales (the id is the sale order)."""
    p = view(t, "v_place")
    hits = joins.geo_nearest(p, p, "id", "id", 5, rule="earlier", qtag=F.col("id"), btag=F.col("id"))
    return hits.join(p.select(F.col("id").alias("bid"), "value"), "bid").groupBy(F.col("qid").alias("id")).agg(rnd(F.avg("value")).alias("mean_5"))


_HEAD = "SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 80"


@query("semi_anti_join", f"SELECT p_partkey, CASE WHEN p_brand IN ({_HEAD}) THEN 'head' ELSE 'tail' END AS part_of FROM part")
def semi_anti_join(t):
    head = t.part.groupBy("p_brand").count().filter("count >= 80")
    p = t.part.select("p_partkey", "p_brand")
    return p.join(head, "p_brand", "left_semi").select("p_partkey", F.lit("head").alias("part_of")).unionByName(
        p.join(head, "p_brand", "left_anti").select("p_partkey", F.lit("tail").alias("part_of")))


@query("audit_join", f"SELECT c_mktsegment, count(*) AS n, {r6('avg(s.score)')} AS mean_score, {r6('avg(s.y)')} AS rate FROM v_scores s JOIN orders o ON s.id = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1")
def audit_join(t):
    held = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey").join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).select("id", "c_mktsegment")
    return view(t, "v_scores").join(held, "id").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("score")).alias("mean_score"), rnd(F.avg("y")).alias("rate"))


@query("feature_join_wide", f"""SELECT o_orderkey, r_name, coalesce(n_lines, 0) AS n_lines, {r6('revenue', 3)} AS revenue, {r6('score')} AS score FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN v_scores ON id = o_orderkey LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def feature_join_wide(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    geo = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")
    s = view(t, "v_scores").select(F.col("id").alias("o_orderkey"), "score")
    return (t.orders.select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left").join(s, "o_orderkey").join(geo, F.col("o_custkey") == F.col("c_custkey"))
            .select("o_orderkey", "r_name", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), rnd("revenue", 3).alias("revenue"), rnd("score").alias("score")))


# ---- sorts, limits, sets -------------------------------------------------------------------------

@query("sort_limit", f"SELECT l_suppkey, {r6('avg(l_discount)')} AS metric FROM lineitem GROUP BY 1 ORDER BY round(avg(l_discount), 9) DESC, l_suppkey LIMIT 10")
def sort_limit(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.avg("l_discount").alias("m")).orderBy(F.round("m", 9).desc(), "l_suppkey").limit(10).select("l_suppkey", rnd("m").alias("metric"))


@query("global_top_k", "SELECT id, CASE WHEN score >= (SELECT quantile_cont(score, .95) FROM v_scores) THEN 1 ELSE 0 END AS in_share, CAST(id IN (SELECT id FROM v_scores ORDER BY score DESC, id LIMIT 100) AS INT) AS in_budget FROM v_scores")
def global_top_k(t):
    s = view(t, "v_scores").select("id", "score")
    cut = exact_quantiles(s, "score", {"q": .95}).scalar()
    top = s.orderBy(F.desc("score"), "id").limit(100).select("id", F.lit(1).alias("hit"))
    return s.join(top, "id", "left").select("id", flag(F.col("score") >= cut).alias("in_share"), F.coalesce("hit", F.lit(0)).alias("in_budget"))


@query("top_override", f"SELECT id, {r6('CASE WHEN amount >= (SELECT quantile_cont(amount, .99) FROM v_scores) THEN score * 1.2 ELSE score END')} AS score FROM v_scores")
def top_override(t):
    s = view(t, "v_scores").select("id", "score", "amount")
    cut = exact_quantiles(s, "amount", {"q": .99}).scalar()
    return s.select("id", rnd(F.when(F.col("amount") >= cut, F.col("score") * 1.2).otherwise(F.col("score"))).alias("score"))


@query("union_relabel", f"SELECT p_partkey, p_brand AS label FROM part WHERE p_brand IN ({_HEAD}) UNION ALL SELECT p_partkey, 'REJECT' AS label FROM part WHERE p_brand NOT IN ({_HEAD}) AND {mix('p_partkey')} < 0.3")
def union_relabel(t):
    from larkspur.functions.scalar import mix_hash
    head = t.part.groupBy("p_brand").count().filter("count >= 80")
    p = t.part.select("p_partkey", "p_brand")
    tail = p.join(head, "p_brand", "left_anti").filter(mix_hash("p_partkey") < 0.3)
    return p.join(head, "p_brand", "left_semi").select("p_partkey", F.col("p_brand").alias("label")).unionByName(tail.select("p_partkey", F.lit("REJECT").alias("label")))


@query("intersect_overlap", """WITH a AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 200), b AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_custkey LIMIT 200)
    SELECT count(*) AS overlap FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def intersect_overlap(t):
    s = t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"), F.count(F.lit(1)).alias("n"))
    a = s.orderBy(F.desc("v"), "o_custkey").limit(200).select("o_custkey")
    return a.intersect(s.orderBy(F.desc("n"), "o_custkey").limit(200).select("o_custkey")).agg(F.count(F.lit(1)).alias("overlap"))


@query("except_seen", "SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-29' EXCEPT SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02'")
def except_seen(t):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    new, old = t.events.filter(F.col("ts") >= at("2024-01-29")), t.events.filter(F.col("ts") < at("2024-01-02"))
    return new.select("user_id").distinct().join(old.select("user_id"), "user_id", "left_anti")
