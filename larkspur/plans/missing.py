"""Missing-value operators."""

from pyspark.sql import Window as W, functions as F

from larkspur.functions.scalar import rnd
from larkspur.operators import clean
from larkspur.operators.windows import over_rows, running
from larkspur.plans.registry import query, r6
from larkspur.plans.views import view


@query("fill_constant", "SELECT event_id, coalesce(value, -1::DOUBLE) AS value, CASE WHEN event_id % 7 = 0 THEN 'Unknown' ELSE event_type END AS event_type FROM v_gap")
def fill_constant(t):
    g = view(t, "v_gap").select("event_id", "value", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"))
    return clean.fill_constant(g, {"value": -1.0, "event_type": "Unknown"})


_TRAIN = "ts < TIMESTAMP '2024-01-25'"


@query("impute_global", f"""WITH m AS (SELECT quantile_cont(value, 0.5) AS med, avg(value) AS mean FROM v_gap WHERE {_TRAIN}),
    k AS (SELECT event_type AS mode FROM (SELECT event_type, count(*) AS n FROM v_gap WHERE {_TRAIN} AND event_id % 7 <> 0 GROUP BY 1) ORDER BY n DESC, event_type LIMIT 1)
    SELECT event_id, {r6('coalesce(value, med)')} AS by_median, {r6('coalesce(value, mean)')} AS by_mean,
    CASE WHEN event_id % 7 = 0 THEN mode ELSE event_type END AS by_mode FROM v_gap, m, k""")
def impute_global(t):
    g = view(t, "v_gap").select("event_id", "ts", F.col("value").alias("by_median"), F.col("value").alias("by_mean"),
                                F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("by_mode"))
    train = F.col("ts") < F.lit("2024-01-25").cast("timestamp_ntz")
    out = clean.impute(g, {"by_median": "median", "by_mean": "mean", "by_mode": "mode"}, train)
    return out.select("event_id", rnd("by_median").alias("by_median"), rnd("by_mean").alias("by_mean"), "by_mode")


@query("impute_grouped", f"""WITH m AS (SELECT user_id, quantile_cont(value, 0.5) AS med FROM v_gap WHERE {_TRAIN} GROUP BY user_id),
    a AS (SELECT quantile_cont(value, 0.5) AS med FROM v_gap WHERE {_TRAIN})
    SELECT event_id, {r6('coalesce(g.value, m.med, a.med)')} AS value FROM v_gap g LEFT JOIN m USING (user_id), a""")
def impute_grouped(t):
    g = view(t, "v_gap").select("event_id", "ts", "user_id", "value")
    train = F.col("ts") < F.lit("2024-01-25").cast("timestamp_ntz")
    return clean.impute(g, {"value": "median"}, train, by=["user_id"]).select("event_id", rnd("value").alias("value"))


@query("ffill", f"SELECT event_id, {r6('last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS value FROM v_gap")
def ffill(t):
    g = running(view(t, "v_gap").withColumn("clock", F.unix_micros(F.col("ts").cast("timestamp"))), ["user_id"], "clock", "event_id",
                {"filled": ("last", F.col("value"))})
    return g.select("event_id", rnd("filled").alias("value"))


@query("interpolate_linear", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM v_gap),
    p AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER w AS i0, last_value(value IGNORE NULLS) OVER w AS v0,
      first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER n AS i1, first_value(value IGNORE NULLS) OVER n AS v1 FROM r
      WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             n AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, {r6('CASE WHEN value IS NOT NULL THEN value WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (i - i0) / (i1 - i0) END')} AS value FROM p""")
def interpolate_linear(t):
    g = view(t, "v_gap").select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("clock"))
    key, known = ["user_id"], F.col("value").isNotNull()
    g = running(g, key, "clock", "event_id", {"i": ("count", F.lit(1))})
    point = F.when(known, F.struct("i", "value"))
    g = running(g, key, "clock", "event_id", {"a": ("last", point)})
    g = running(g, key, "clock", "event_id", {"b": ("last", point)}, descending=True)
    line = F.col("a.value") + (F.col("b.value") - F.col("a.value")) * (F.col("i") - F.col("a.i")) / F.nullif(F.col("b.i") - F.col("a.i"), F.lit(0))
    out = F.when(known, F.col("value")).when(F.col("b").isNull(), F.col("a.value")).otherwise(line)
    return g.select("event_id", rnd(out).alias("value"))


@query("fill_rolling_mean", f"""SELECT event_id, {r6('coalesce(value, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))')} AS value FROM v_gap""")
def fill_rolling_mean(t):
    g = view(t, "v_gap").withColumn("clock", F.unix_micros(F.col("ts").cast("timestamp")))
    g = over_rows(g, ["user_id"], "clock", "event_id", lambda w: {"m": F.avg("value").over(w.rowsBetween(-6, 0))}, before=6)
    return g.select("event_id", rnd(F.coalesce("value", "m")).alias("value"))


@query("informative_missing", f"SELECT CAST(value IS NULL AS INT) AS is_missing, count(*) AS n, {r6('avg(CAST(event_type = ' + chr(39) + 'purchase' + chr(39) + ' AS INT))')} AS target_rate FROM v_gap GROUP BY 1")
def informative_missing(t):
    return view(t, "v_gap").groupBy(F.col("value").isNull().cast("int").alias("is_missing")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg((F.col("event_type") == "purchase").cast("int"))).alias("target_rate"))
