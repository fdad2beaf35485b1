"""Window features per entity."""

from pyspark.sql import Window as W, functions as F

from larkspur.functions.scalar import flag, ratio, rnd
from larkspur.operators.calendar import densify
from larkspur.operators.prefix import average_rank, exact_quantiles
from larkspur.operators.windows import at_least, group_values, over_rows, range_sums, running
from larkspur.plans.registry import query, r6
from larkspur.plans.views import view

KEY = ["user_id"]
DAY_US = 86_400_000_000


def events(t):
    """Events with an integer clock (microseconds)."""
    return t.events.select("event_id", "ts", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("clock"))


def rows(df, exprs, before=0, after=0, keys=KEY):
    return over_rows(df, keys, "clock", "event_id", exprs, before, after)


_W = "(PARTITION BY user_id ORDER BY ts, event_id)"


@query("rolling_mean", f"""WITH d AS (SELECT c_mktsegment AS seg, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS day, sum(o_totalprice) AS rev FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    g AS (SELECT seg, unnest(range((SELECT min(day) FROM d), (SELECT max(day) + 1 FROM d))) AS day FROM (SELECT DISTINCT seg FROM d)),
    p AS (SELECT g.seg, g.day, coalesce(rev, 0) AS rev FROM g LEFT JOIN d ON g.seg = d.seg AND g.day = d.day)
    SELECT seg, CAST(day AS INT) AS day, {r6('rev', 2)} AS rev, {r6('CASE WHEN count(rev) OVER w7 >= 7 THEN avg(rev) OVER w7 END', 3)} AS mean_7, {r6('CASE WHEN count(rev) OVER w28 >= 28 THEN avg(rev) OVER w28 END', 3)} AS mean_28
    FROM p WINDOW w7 AS (PARTITION BY seg ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), w28 AS (PARTITION BY seg ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)""")
def rolling_mean(t):
    """Shifted rolling means of daily revenue per customer segment (flagship)."""
    o = t.orders.select("o_custkey", "o_totalprice", F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("day"))
    d = o.join(t.customer.select("c_custkey", F.col("c_mktsegment").alias("seg")), F.col("o_custkey") == F.col("c_custkey"))
    d = densify(d.groupBy("seg", "day").agg(F.sum("o_totalprice").alias("rev")), ["seg"], "day", {"rev": 0.0})

    def means(w):
        out = {}
        for n in (7, 28):
            f = w.rowsBetween(-n, -1)
            out[f"mean_{n}"] = at_least(f, "rev", n, F.avg("rev").over(f))
        return out

    p = over_rows(d, ["seg"], "day", "day", means, before=28)
    return p.select("seg", "day", rnd("rev", 2).alias("rev"), rnd("mean_7", 3).alias("mean_7"), rnd("mean_28", 3).alias("mean_28"))


@query("lag_features", f"SELECT event_id, {', '.join(r6(f'lag(value, {k}) OVER w') + f' AS lag_{k}' for k in (1, 2, 7, 14))} FROM events WINDOW w AS {_W}")
def lag_features(t):
    e = rows(events(t), lambda w: {f"lag_{k}": F.lag("value", k).over(w) for k in (1, 2, 7, 14)}, before=14)
    return e.select("event_id", *[rnd(f"lag_{k}").alias(f"lag_{k}") for k in (1, 2, 7, 14)])


@query("lead_features", f"SELECT event_id, {', '.join(r6(f'lead(value, {k}) OVER w') + f' AS lead_{k}' for k in (1, 7))} FROM events WINDOW w AS {_W}")
def lead_features(t):
    e = rows(events(t), lambda w: {f"lead_{k}": F.lead("value", k).over(w) for k in (1, 7)}, after=7)
    return e.select("event_id", *[rnd(f"lead_{k}").alias(f"lead_{k}") for k in (1, 7)])


_F7 = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"


@query("rolling_std", f"SELECT event_id, {r6('CASE WHEN count(value) OVER w >= 7 THEN stddev_samp(value) OVER w END')} AS std_7 FROM v_gap WINDOW w AS {_F7}")
def rolling_std(t):
    def std(w):
        f = w.rowsBetween(-7, -1)
        return {"std_7": at_least(f, "value", 7, F.stddev_samp("value").over(f))}
    g = view(t, "v_gap").withColumn("clock", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows(g, std, before=7).select("event_id", rnd("std_7").alias("std_7"))


@query("rolling_max", f"SELECT event_id, {r6('CASE WHEN count(value) OVER w >= 3 THEN max(value) OVER w END')} AS max_7, {r6('CASE WHEN count(value) OVER w >= 3 THEN min(value) OVER w END')} AS min_7 FROM v_gap WINDOW w AS {_F7}")
def rolling_max(t):
    def top(w):
        f = w.rowsBetween(-7, -1)
        return {"max_7": at_least(f, "value", 3, F.max("value").over(f)), "min_7": at_least(f, "value", 3, F.min("value").over(f))}
    g = view(t, "v_gap").withColumn("clock", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows(g, top, before=7).select("event_id", rnd("max_7").alias("max_7"), rnd("min_7").alias("min_7"))


@query("rolling_current", f"""SELECT event_id, {', '.join(r6(f'avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)') + f' AS mean_{n}' for n in (6, 24, 72))},
    {r6('max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)')} AS max_24 FROM events""")
def rolling_current(t):
    def feats(w):
        out = {f"mean_{n}": F.avg("value").over(w.rowsBetween(1 - n, 0)) for n in (6, 24, 72)}
        return {**out, "max_24": F.max("value").over(w.rowsBetween(-23, 0))}
    e = rows(events(t), feats, before=71)
    return e.select("event_id", *[rnd(c).alias(c) for c in ("mean_6", "mean_24", "mean_72", "max_24")])


@query("rolling_by_time", f"""WITH e AS (SELECT *, epoch_us(ts) AS c FROM events) SELECT event_id, count(value) OVER w AS n_30m, {r6('avg(value) OVER w')} AS mean_30m FROM e WINDOW w AS (PARTITION BY event_type ORDER BY c RANGE BETWEEN 1800000000 PRECEDING AND 1 PRECEDING)""")
def rolling_by_time(t):
    span = 1_800_000_000
    e = range_sums(events(t), "event_id", ["event_type"], "clock", {"n_30m": (span, F.lit(1).cast("bigint")), "sum_30m": (span, F.col("value"))})
    return e.select("event_id", "n_30m", rnd(ratio("sum_30m", "n_30m")).alias("mean_30m"))


@query("history_mean_3", f"SELECT event_id, {r6('avg(value) OVER w3')} AS hist_3, {r6('CASE WHEN count(value) OVER w10 >= 5 THEN avg(value) OVER w10 END')} AS hist_10 FROM events WINDOW w3 AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w10 AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
def history_mean_3(t):
    def feats(w):
        f3, f10 = w.rowsBetween(-3, -1), w.rowsBetween(-10, -1)
        return {"hist_3": F.avg("value").over(f3), "hist_10": at_least(f10, "value", 5, F.avg("value").over(f10))}
    e = rows(events(t), feats, before=10, keys=["user_id", "event_type"])
    return e.select("event_id", rnd("hist_3").alias("hist_3"), rnd("hist_10").alias("hist_10"))


@query("diff_k", f"SELECT event_id, {r6('value - lag(value, 1) OVER w')} AS diff_1, {r6('value - lag(value, 7) OVER w')} AS diff_7, {r6('value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w')} AS second_diff FROM events WINDOW w AS {_W}")
def diff_k(t):
    v = F.col("value")
    def feats(w):
        lag = lambda k: F.lag("value", k).over(w)
        return {"diff_1": v - lag(1), "diff_7": v - lag(7), "second_diff": v - 2 * lag(1) + lag(2)}
    return rows(events(t), feats, before=7).select("event_id", *[rnd(c).alias(c) for c in ("diff_1", "diff_7", "second_diff")])


@query("trend_ratio", f"SELECT event_id, {r6('avg(value) OVER a / (avg(value) OVER b + 0.01::DOUBLE)')} AS trend FROM events WINDOW a AS {_F7}, b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)")
def trend_ratio(t):
    e = rows(events(t), lambda w: {"trend": F.avg("value").over(w.rowsBetween(-7, -1)) / (F.avg("value").over(w.rowsBetween(-28, -1)) + 0.01)}, before=28)
    return e.select("event_id", rnd("trend").alias("trend"))


_HOURLY = """h AS (SELECT event_type, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) / 3600 AS BIGINT) AS hr, count(*) AS n FROM events GROUP BY 1, 2),
    g AS (SELECT event_type, unnest(range((SELECT min(hr) FROM h), (SELECT max(hr) + 1 FROM h))) AS hr FROM (SELECT DISTINCT event_type FROM h)),
    p AS (SELECT g.event_type, g.hr, coalesce(n, 0) AS n, g.hr % 24 AS hod, (g.hr // 24 + 3) % 7 AS dow FROM g LEFT JOIN h ON g.event_type = h.event_type AND g.hr = h.hr)"""


def hourly(t):
    """Hourly event counts per type on a full grid; day 0 of the epoch was a Thursday (3)."""
    hr = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    h = t.events.groupBy("event_type", hr.alias("hr")).agg(F.count(F.lit(1)).alias("n"))
    p = densify(h, ["event_type"], "hr", {"n": 0})
    return p.withColumns({"hod": F.col("hr") % 24, "dow": (F.floor(F.col("hr") / 24) + 3) % 7})


@query("same_slot_lag", f"WITH {_HOURLY} SELECT event_type, hr, n, {r6('lag(n) OVER (PARTITION BY event_type, dow, hod ORDER BY hr)')} AS last_week, {r6('lag(n) OVER (PARTITION BY event_type, hod ORDER BY hr)')} AS yesterday FROM p")
def same_slot_lag(t):
    p = hourly(t)
    p = over_rows(p, ["event_type", "dow", "hod"], "hr", "hr", lambda w: {"last_week": F.lag("n").over(w)}, before=1)
    p = over_rows(p, ["event_type", "hod"], "hr", "hr", lambda w: {"yesterday": F.lag("n").over(w)}, before=1)
    return p.select("event_type", "hr", "n", rnd("last_week").alias("last_week"), rnd("yesterday").alias("yesterday"))


@query("same_weekday_mean", f"WITH {_HOURLY} SELECT event_type, hr, {r6('CASE WHEN count(n) OVER w >= 2 THEN avg(n) OVER w END')} AS mean_4w FROM p WINDOW w AS (PARTITION BY event_type, dow, hod ORDER BY hr ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)")
def same_weekday_mean(t):
    def feats(w):
        f = w.rowsBetween(-4, -1)
        return {"mean_4w": at_least(f, "n", 2, F.avg("n").over(f))}
    p = over_rows(hourly(t), ["event_type", "dow", "hod"], "hr", "hr", feats, before=4)
    return p.select("event_type", "hr", rnd("mean_4w").alias("mean_4w"))


@query("baseline_deviation", f"""SELECT event_id, {r6('value - CASE WHEN count(value) OVER w >= 12 THEN avg(value) OVER w END')} AS deviation, {r6('(value - CASE WHEN count(value) OVER w >= 12 THEN avg(value) OVER w END) / (CASE WHEN count(value) OVER w >= 12 THEN avg(value) OVER w END + 0.01::DOUBLE)')} AS relative
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 719 PRECEDING AND CURRENT ROW)""")
def baseline_deviation(t):
    def base(w):
        f = w.rowsBetween(-719, 0)
        return {"base": at_least(f, "value", 12, F.avg("value").over(f))}
    e = rows(events(t), base, before=719)
    dev = F.col("value") - F.col("base")
    return e.select("event_id", rnd(dev).alias("deviation"), rnd(dev / (F.col("base") + 0.01)).alias("relative"))


@query("group_normalize", f"SELECT event_id, {r6('value / avg(value) OVER (PARTITION BY user_id)')} AS value_norm FROM events")
def group_normalize(t):
    e = group_values(t.events.select("event_id", "user_id", "value"), KEY, {"m": F.avg("value")})
    return e.select("event_id", rnd(ratio("value", "m")).alias("value_norm"))


@query("cross_section_z", f"""WITH s AS (SELECT CAST(ts AS DATE) AS d, avg(value) AS m, stddev_samp(value) AS sd, quantile_cont(value, .5) AS med FROM events GROUP BY 1), g AS (SELECT CAST(ts AS DATE) AS d, event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1, 2)
    SELECT event_id, {r6('(value - s.m) / s.sd')} AS z, {r6('(value - s.med) / s.sd')} AS z_median, {r6('(value - g.m) / nullif(g.sd, 0)')} AS z_sector FROM events e JOIN s ON CAST(ts AS DATE) = s.d JOIN g ON CAST(ts AS DATE) = g.d AND e.event_type = g.event_type""")
def cross_section_z(t):
    e = t.events.select("event_id", "event_type", "value", F.to_date("ts").alias("d"))
    e = group_values(e, ["d"], {"m": F.avg("value"), "sd": F.stddev_samp("value")})
    e = group_values(e, ["d", "event_type"], {"gm": F.avg("value"), "gsd": F.stddev_samp("value")})
    e = e.join(exact_quantiles(t.events.select("value", F.to_date("ts").alias("d")), "value", {"med": .5}, ["d"]), "d")
    v = F.col("value")
    return e.select("event_id", rnd(ratio(v - F.col("m"), "sd")).alias("z"), rnd(ratio(v - F.col("med"), "sd")).alias("z_median"), rnd(ratio(v - F.col("gm"), "gsd")).alias("z_sector"))


@query("pct_rank_avg", f"""SELECT event_id, {r6('(rank() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value) + (count(*) OVER (PARTITION BY CAST(ts AS DATE), value) - 1) / 2.0::DOUBLE) / count(value) OVER (PARTITION BY CAST(ts AS DATE))')} AS pct FROM events""")
def pct_rank_avg(t):
    e = t.events.select("event_id", "value", F.to_date("ts").alias("d"))
    r = average_rank(e, "value", ["d"])
    return e.join(r, ["d", "value"]).select("event_id", rnd(F.col("avg_rank") / F.col("tot_n")).alias("pct"))


@query("seen_count", f"SELECT event_id, row_number() OVER {_W} - 1 AS seen, CAST(row_number() OVER {_W} - 1 < 30 AS INT) AS is_new FROM events")
def seen_count(t):
    e = running(events(t), KEY, "clock", "event_id", {"seen": ("count", F.lit(1))})
    return e.select("event_id", (F.col("seen") - 1).alias("seen"), flag(F.col("seen") - 1 < 30).alias("is_new"))


@query("days_since_event", f"""SELECT event_id, {r6("date_diff('day', CAST(max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DATE), CAST(ts AS DATE))")} AS days FROM events""")
def days_since_event(t):
    e = running(events(t), KEY, "clock", "event_id", {"last": ("max", F.when(F.col("event_type") == "purchase", F.to_date("ts")))}, include_current=False)
    return e.select("event_id", rnd(F.datediff(F.to_date("ts"), "last")).alias("days"))


@query("velocity_features", f"""WITH e AS (SELECT *, epoch_us(ts) AS c FROM events) SELECT event_id, {r6('avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)')} AS last5_mean,
    count(*) OVER d AS n_24h, {r6('sum(value) OVER d')} AS sum_24h, {r6('(count(*) OVER d) / ((count(*) OVER m) / 30.0::DOUBLE + 0.01::DOUBLE)')} AS vs_month
    FROM e WINDOW d AS (PARTITION BY user_id ORDER BY c RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING), m AS (PARTITION BY user_id ORDER BY c RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING)""")
def velocity_features(t):
    e = rows(events(t), lambda w: {"last5_mean": F.avg("value").over(w.rowsBetween(-5, -1))}, before=5)
    one = F.lit(1).cast("bigint")
    e = range_sums(e, "event_id", KEY, "clock", {"n_24h": (DAY_US, one), "sum_24h": (DAY_US, F.col("value")), "n_30d": (30 * DAY_US, one)})
    return e.select("event_id", rnd("last5_mean").alias("last5_mean"), "n_24h", rnd(F.when(F.col("n_24h") > 0, F.col("sum_24h"))).alias("sum_24h"), rnd(F.col("n_24h") / (F.col("n_30d") / F.lit(30.0) + 0.01)).alias("vs_month"))


@query("expanding_target_mean", f"""SELECT event_id, {r6("avg(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")} AS prior_rate FROM events""")
def expanding_target_mean(t):
    e = running(events(t), KEY, "clock", "event_id", {"s": ("sum", flag(F.col("event_type") == "purchase")), "n": ("count", F.lit(1))}, include_current=False)
    return e.select("event_id", rnd(ratio("s", "n")).alias("prior_rate"))


@query("forward_sum", f"SELECT event_id, {r6('CASE WHEN count(*) OVER w = 5 THEN sum(value) OVER w END')} AS next_5 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)")
def forward_sum(t):
    def ahead(w):
        f = w.rowsBetween(1, 5)
        return {"next_5": F.when(F.count(F.lit(1)).over(f) == 5, F.sum("value").over(f))}
    return rows(events(t), ahead, after=5).select("event_id", rnd("next_5").alias("next_5"))


@query("run_length", """WITH r AS (SELECT user_id, value > 20 AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY user_id, value > 20 ORDER BY ts, event_id) AS j FROM events),
    g AS (SELECT user_id, i - j AS grp, count(*) AS n FROM r WHERE hit GROUP BY 1, 2) SELECT u.user_id, coalesce(max(n), 0) AS longest FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN g ON u.user_id = g.user_id GROUP BY 1""")
def run_length(t):
    hit = F.col("value") > 20
    e = running(events(t), KEY, "clock", "event_id", {"i": ("count", F.lit(1)), "j": ("sum", flag(hit))})
    islands = e.groupBy("user_id", (F.col("i") - F.col("j")).alias("island")).agg(F.sum(flag(hit)).alias("n"))
    return islands.groupBy("user_id").agg(F.max("n").alias("longest"))


@query("top_k_per_group", f"""WITH m AS (SELECT CAST(ts AS DATE) AS d, user_id, max(value) AS score FROM events GROUP BY 1, 2)
    SELECT CAST(d AS VARCHAR) AS d, user_id, {r6('score')} AS score, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY d ORDER BY score DESC, user_id) AS INT) AS rn FROM m) WHERE rn <= 10""")
def top_k_per_group(t):
    m = t.events.groupBy(F.to_date("ts").alias("d"), "user_id").agg(F.max("value").alias("score"))
    rn = F.row_number().over(W.partitionBy("d").orderBy(F.desc("score"), "user_id"))
    return m.withColumn("rn", rn).filter("rn <= 10").select(F.col("d").cast("string").alias("d"), "user_id", rnd("score").alias("score"), "rn")


@query("long_short_return", f"""WITH m AS (SELECT CAST(ts AS DATE) AS d, user_id, avg(value) AS pred, max(value) AS actual FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY pred DESC, user_id) AS a, row_number() OVER (PARTITION BY d ORDER BY pred, user_id) AS b FROM m)
    SELECT CAST(d AS VARCHAR) AS d, {r6('avg(CASE WHEN a <= 10 THEN actual END) - avg(CASE WHEN b <= 10 THEN actual END) - 0.0005')} AS ret FROM r GROUP BY 1""")
def long_short_return(t):
    m = t.events.groupBy(F.to_date("ts").alias("d"), "user_id").agg(F.avg("value").alias("pred"), F.max("value").alias("actual"))
    def side(order, sign):
        rn = F.row_number().over(W.partitionBy("d").orderBy(order, "user_id"))
        return m.withColumn("rn", rn).filter("rn <= 10").groupBy("d").agg((sign * F.avg("actual")).alias("leg"))
    both = side(F.desc("pred"), 1).unionByName(side(F.asc("pred"), -1))
    return both.groupBy(F.col("d").cast("string").alias("d")).agg(rnd(F.sum("leg") - 0.0005).alias("ret"))


@query("drawdown_sharpe", f"""WITH r AS (SELECT event_type, CAST(ts AS DATE) AS d, avg(value) / 1000 - 0.04 AS ret FROM events GROUP BY 1, 2), c AS (SELECT *, sum(ret) OVER (PARTITION BY event_type ORDER BY d) AS cum FROM r), p AS (SELECT *, greatest(max(cum) OVER (PARTITION BY event_type ORDER BY d), 0) AS peak FROM c)
    SELECT event_type, {r6('avg(ret) * 252')} AS ann_mean, {r6('stddev_samp(ret) * sqrt(252)')} AS ann_vol, {r6('avg(ret) * 252 / (stddev_samp(ret) * sqrt(252))')} AS sharpe, {r6('min(cum - peak)')} AS max_drawdown FROM p GROUP BY 1""")
def drawdown_sharpe(t):
    r = t.events.groupBy("event_type", F.to_date("ts").alias("d")).agg((F.avg("value") / 1000 - 0.04).alias("ret")).withColumn("day", F.datediff("d", F.lit("1970-01-01").cast("date")))
    c = running(r, ["event_type"], "day", "day", {"cum": ("sum", F.col("ret"))})
    c = running(c, ["event_type"], "day", "day", {"peak": ("max", F.col("cum"))})
    mean, vol = F.avg("ret") * 252, F.stddev_samp("ret") * F.sqrt(F.lit(252.0))
    return c.groupBy("event_type").agg(rnd(mean).alias("ann_mean"), rnd(vol).alias("ann_vol"), rnd(mean / vol).alias("sharpe"),
                                       rnd(F.min(F.col("cum") - F.greatest("peak", F.lit(0.0)))).alias("max_drawdown"))


@query("outlier_vs_group_q", "WITH q AS (SELECT user_id, quantile_cont(value, .9) AS q FROM events GROUP BY 1) SELECT event_id, CAST(value > 3 * q AS INT) AS is_outlier FROM events JOIN q USING (user_id)")
def outlier_vs_group_q(t):
    e = t.events.select("event_id", "user_id", "value")
    return e.join(exact_quantiles(e, "value", {"q": .9}, KEY), "user_id").select("event_id", flag(F.col("value") > 3 * F.col("q")).alias("is_outlier"))


@query("rolling_threshold_alert", "SELECT event_id, CAST(coalesce(count(value) OVER w >= 10 AND abs(value - avg(value) OVER w) > 2.5 * stddev_samp(value) OVER w, false) AS INT) AS alert FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def rolling_threshold_alert(t):
    def feats(w):
        f = w.rowsBetween(-20, -1)
        return {"alert": flag((F.count("value").over(f) >= 10) & (F.abs(F.col("value") - F.avg("value").over(f)) > 2.5 * F.stddev_samp("value").over(f)))}
    return rows(events(t), feats, before=20).select("event_id", "alert")


@query("fatigue_counts", f"""WITH e AS (SELECT *, epoch_us(ts) AS c FROM events) SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY c RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING) AS times_30d, {r6('(c - lag(c) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 86400000000.0::DOUBLE')} AS days_since FROM e""")
def fatigue_counts(t):
    e = range_sums(events(t), "event_id", KEY, "clock", {"times_30d": (30 * DAY_US, F.lit(1).cast("bigint"))})
    e = rows(e, lambda w: {"prev": F.lag("clock").over(w)}, before=1)
    return e.select("event_id", "times_30d", rnd((F.col("clock") - F.col("prev")) / F.lit(float(DAY_US))).alias("days_since"))
