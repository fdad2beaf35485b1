"""Date and calendar features."""

from pyspark.sql import functions as F

from larkspur.functions.scalar import flag, rnd
from larkspur.operators.calendar import calendar_parts, cyclical, densify
from larkspur.operators.joins import asof
from larkspur.plans.registry import query, r6

#: Distances beyond this many days count as this many
MAX_HOLIDAY_DAYS = 60


@query("calendar_parts", """SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INT) AS dow, CAST(day(o_orderdate) AS INT) AS dom, CAST(week(o_orderdate) AS INT) AS iso_week, CAST(month(o_orderdate) AS INT) AS month,
    CAST(quarter(o_orderdate) AS INT) AS quarter, CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(isodow(o_orderdate) >= 6 AS INT) AS is_weekend, CAST(day(o_orderdate) = 1 AS INT) AS month_start,
    CAST(last_day(o_orderdate) = CAST(o_orderdate AS DATE) AS INT) AS month_end FROM orders""")
def q_calendar_parts(t):
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in calendar_parts("o_orderdate").items()])


@query("cyclical", f"""SELECT event_id, {', '.join(r6(f'{f}(2 * pi() * {e} / {p})') + f' AS {n}_{f}' for e, p, n in (('hour(ts)', '24.0::DOUBLE', 'hour'), ('(isodow(ts) - 1)', '7.0::DOUBLE', 'dow'), ('(hour(ts) * 60 + minute(ts))', '1440.0::DOUBLE', 'minute')) for f in ('sin', 'cos'))} FROM events""")
def q_cyclical(t):
    parts = {**cyclical(F.hour("ts"), 24, "hour"), **cyclical(F.weekday("ts"), 7, "dow"), **cyclical(F.hour("ts") * 60 + F.minute("ts"), 1440, "minute")}
    return t.events.select("event_id", *[rnd(c).alias(n) for n, c in parts.items()])


@query("time_flags", """SELECT event_id, CAST(hour(ts) BETWEEN 0 AND 5 AS INT) AS night, CAST(isodow(ts) <= 5 AND (hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 16 AND 18) AS INT) AS rush,
    CAST(isodow(ts) <= 5 AND hour(ts) BETWEEN 8 AND 18 AS INT) AS business, CAST(month(ts) IN (12, 1, 2) AS INT) AS winter, CAST(day(ts) <= 5 AS INT) AS billing_peak, CAST(month(ts) = 1 AND day(ts) = 1 AS INT) AS new_year FROM events""")
def time_flags(t):
    h, work = F.hour("ts"), F.weekday("ts") < 5
    return t.events.select(
        "event_id", flag(h.between(0, 5)).alias("night"), flag(work & (h.between(7, 9) | h.between(16, 18))).alias("rush"),
        flag(work & h.between(8, 18)).alias("business"), flag(F.month("ts").isin(12, 1, 2)).alias("winter"),
        flag(F.dayofmonth("ts") <= 5).alias("billing_peak"), flag((F.month("ts") == 1) & (F.dayofmonth("ts") == 1)).alias("new_year"))


@query("holiday_distance", """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), y AS (SELECT unnest(range((SELECT min(year(d)) - 1 FROM o), (SELECT max(year(d)) + 2 FROM o))) AS y),
    h AS (SELECT make_date(y, 12, 25) AS d FROM y UNION ALL SELECT make_date(y, 11, 1) + CAST((11 - isodow(make_date(y, 11, 1))) % 7 + 21 AS INT) FROM y)
    SELECT o_orderkey, CAST(coalesce(min(CASE WHEN h.d >= o.d THEN least(date_diff('day', o.d, h.d), 60) END), 60) AS INT) AS days_to, CAST(coalesce(min(CASE WHEN h.d <= o.d THEN least(date_diff('day', h.d, o.d), 60) END), 60) AS INT) AS days_since
    FROM o, h GROUP BY o_orderkey""")
def holiday_distance(t):
    """Days to and since the nearest Christmas or Thanksgiving (fourth Thursday of November); those of three years can be in reach."""
    d = F.to_date("o_orderdate")
    years = [F.year(d) + i for i in (-1, 0, 1)]
    thanks = [F.date_add(F.next_day(F.make_date(y, F.lit(10), F.lit(31)), "Thu"), 21) for y in years]
    days = F.array(*[F.make_date(y, F.lit(12), F.lit(25)) for y in years], *thanks)
    ahead = F.array_min(F.transform(F.filter(days, lambda h: h >= d), lambda h: F.datediff(h, d)))
    behind = F.array_min(F.transform(F.filter(days, lambda h: h <= d), lambda h: F.datediff(d, h)))
    cap = F.lit(MAX_HOLIDAY_DAYS)
    return t.orders.select("o_orderkey", F.least(F.coalesce(ahead, cap), cap).alias("days_to"), F.least(F.coalesce(behind, cap), cap).alias("days_since"))


@query("time_slot", """SELECT event_id, CAST(hour(ts) * 4 + minute(ts) // 15 AS INT) AS slot, CAST(hour(ts) * 60 + minute(ts) AS INT) AS minute_of_day, CAST(epoch_us(time_bucket(INTERVAL 15 MINUTE, ts)) AS BIGINT) AS slot_start FROM events""")
def time_slot(t):
    start = F.unix_micros(F.window(F.col("ts").cast("timestamp"), "15 minutes")["start"])
    return t.events.select("event_id", (F.hour("ts") * 4 + F.floor(F.minute("ts") / 15)).cast("int").alias("slot"),
                           (F.hour("ts") * 60 + F.minute("ts")).alias("minute_of_day"), start.alias("slot_start"))


@query("densify_grid", """WITH c AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, count(*) AS n FROM events GROUP BY 1, 2),
    g AS (SELECT user_id, unnest(range((SELECT min(day) FROM c), (SELECT max(day) + 1 FROM c))) AS day FROM (SELECT DISTINCT user_id FROM c))
    SELECT g.user_id, CAST(g.day AS INT) AS day, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.user_id = c.user_id AND g.day = c.day""")
def densify_grid(t):
    c = t.events.groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return densify(c, ["user_id"], "day", {"n": 0})


@query("maturity_cohort", """WITH f AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first FROM orders GROUP BY 1)
    SELECT o_custkey, year(first) || 'Q' || quarter(first) AS cohort, CASE WHEN date_diff('day', first, DATE '2001-08-01') >= 1095 THEN 'mature' WHEN date_diff('day', first, DATE '2001-08-01') >= 365 THEN 'censored' ELSE 'too_new' END AS maturity FROM f""")
def maturity_cohort(t):
    f = t.orders.groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("first"))
    seen = F.datediff(F.lit("2001-08-01").cast("date"), "first")
    return f.select("o_custkey", F.concat(F.year("first"), F.lit("Q"), F.quarter("first")).alias("cohort"),
                    F.when(seen >= 1095, "mature").when(seen >= 365, "censored").otherwise("too_new").alias("maturity"))
