"""Sources, sinks, bundles and streams."""

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F, types as T

from larkspur.functions.scalar import flag, rnd
from larkspur.metrics import drift as dr
from larkspur.models import linear as ln
from larkspur.models.fitting import feature_stages, p1
from larkspur.plans.learning import NUM, cls, halves, online_steps
from larkspur.plans.monitoring import REASONS, WEIGHTS, contributions
from larkspur.plans.registry import query, r6
from larkspur.session import scratch_path
from larkspur.sources import bundle as bd
from larkspur.sources.tables import read_csv_typed, write_table
from larkspur.streaming.durable import BatchState, late_split
from larkspur.streaming.ordered import in_time_order, last_mean, running_alarm
from larkspur.streaming.runner import Replay



@query("scan_csv", f"SELECT p_partkey, p_name, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS p_size, {r6('p_retailprice')} AS p_retailprice FROM part")
def scan_csv(t):
    """Round trip through CSV; every thirteenth size is unreadable and must come back as NULL."""
    path = scratch_path(t.spark, "csv")
    p = t.part.select("p_partkey", "p_name", F.when(F.col("p_partkey") % 13 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("p_size"), "p_retailprice")
    write_table(p, path, fmt="csv")
    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("p_size", T.DoubleType()), T.StructField("p_retailprice", T.DoubleType())])
    return read_csv_typed(t.spark, path, schema).withColumn("p_retailprice", rnd("p_retailprice"))


@query("sink_table", f"SELECT o_orderstatus, count(*) AS n, {r6('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY 1")
def sink_table(t):
    path = scratch_path(t.spark, "table")
    write_table(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"])
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total"))


def fitted(t):
    d = cls(t)
    train, _ = halves(d)
    return d, Pipeline(stages=[*feature_stages(NUM, ["grp"]), LogisticRegression(labelCol="y", maxIter=20)]).fit(train)


@query("save_bundle")
def save_bundle(t):
    _, model = fitted(t)
    path = scratch_path(t.spark, "bundle")
    bd.save_bundle(model, path, "v1", 0.4, {"features": ",".join(NUM)})
    return t.spark.read.parquet(f"{path}/meta")


@query("load_bundle")
def load_bundle(t):
    """Predictions before saving and after loading, side by side."""
    d, model = fitted(t)
    path = scratch_path(t.spark, "bundle")
    bd.save_bundle(model, path, "v1", 0.4, {})
    again, _, meta = bd.load_bundle(t.spark, path)
    a = model.transform(d).select("id", rnd(p1()).alias("before"))
    b = bd.decide(again.transform(d).drop("probability_"), p1(), meta["threshold"], meta["version"]).select("id", rnd("probability").alias("after"), "prediction", "version")
    return a.join(b, "id")


def score_col():
    return ln.dot(list(WEIGHTS), list(WEIGHTS.values()), -15.0)
_SCORE = "1 / (1 + exp(-(-15.0::DOUBLE + " + " + ".join(f"{c} * {w}::DOUBLE" for c, w in WEIGHTS.items()) + ")))"


@query("score_batch", f"""WITH p AS (SELECT l_orderkey, l_linenumber, {_SCORE} AS p FROM lineitem) SELECT l_orderkey, l_linenumber, {r6('p')} AS probability, CAST(p >= .5 AS INT) AS prediction, CASE WHEN p >= .5 THEN 'yes' ELSE 'no' END AS label, 'v1' AS version, 0.5::DOUBLE AS threshold FROM p""")
def score_batch(t):
    s = bd.decide(t.lineitem.select("l_orderkey", "l_linenumber", *WEIGHTS), 1 / (1 + F.exp(-score_col())), 0.5, "v1")
    return s.select("l_orderkey", "l_linenumber", rnd("probability").alias("probability"), "prediction", "label", "version", "threshold")


@query("prediction_log")
def prediction_log(t):
    path = scratch_path(t.spark, "log")
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", *WEIGHTS)
    s = bd.decide(contributions(li, WEIGHTS), 1 / (1 + F.exp(-score_col())), 0.5, "v1")
    codes = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    bd.append_log(s, path, ["l_orderkey", "l_linenumber"], F.transform(F.slice("cells", 1, 3), lambda x: codes[x["feature"]]), F.trunc("l_shipdate", "month").cast("timestamp"))
    return t.spark.read.parquet(path).groupBy("day", "version").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("probability")).alias("mean_p"), F.min(F.length("input_hash")).alias("hash_len"), F.min(F.size("reasons")).alias("n_reasons"))


# ---- streams -------------------------------------------------------------------------------------

def stream_events(t):
    return t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def parts(t, n=3):
    """Events in ``n`` consecutive time ranges."""
    e = stream_events(t)
    ends = e.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    low, high = (ends[0] or 0), (ends[1] or 0)
    clock = F.coalesce(F.unix_micros("ts"), F.lit(low))
    part = F.least(F.floor((clock - low) * n / max(1, high - low)), F.lit(n - 1))
    return [e.filter(part == i) for i in range(n)]


def flush(t):
    """One row per far-future moment of the data's last event, to let the watermark close every window."""
    last = stream_events(t).orderBy(F.desc("ts"), "event_id").limit(1)
    return last.withColumn("ts", F.expr("ts + interval 400 days"))


def windows_of(t, label, build):
    """Replay the parts, close the windows, return the sink."""
    r = Replay(t.spark, label)
    for p in parts(t):
        r.land(p)
        r.run(build)
    r.land(flush(t))
    r.run(build)
    return r.result()


LATE = "2 days"


@query("stream_tumbling", f"""SELECT CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, {r6('avg(value)')} AS mean, {r6("avg(CAST(event_type = 'error' AS INT))")} AS error_rate FROM events GROUP BY 1, 2""")
def stream_tumbling(t):
    def build(s):
        g = s.withWatermark("ts", LATE).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        g = g.agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("value")).alias("mean"), rnd(F.avg(flag(F.col("event_type") == "error"))).alias("error_rate"))
        return g.select(F.unix_micros("w.start").alias("start"), "event_type", "n", "mean", "error_rate")
    return windows_of(t, "tumbling", build)


@query("stream_sliding", f"SELECT CAST(s AS BIGINT) AS start, event_type, count(*) AS n, {r6('avg(value)')} AS mean FROM (SELECT event_type, value, unnest(list_transform(range(0, 6), lambda i: (epoch_us(ts) // 300000000 - i) * 300000000)) AS s FROM events) GROUP BY 1, 2")
def stream_sliding(t):
    def build(s):
        g = s.withWatermark("ts", LATE).groupBy(F.window("ts", "30 minutes", "5 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("value")).alias("mean"))
        return g.select(F.unix_micros("w.start").alias("start"), "event_type", "n", "mean")
    return windows_of(t, "sliding", build)


@query("stream_session", f"""WITH g AS (SELECT *, CAST(coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 21600000000, true) AS INT) AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
    SELECT user_id, CAST(min(epoch_us(ts)) AS BIGINT) AS start, count(*) AS n, {r6('sum(value)')} AS total FROM s GROUP BY user_id, sid""")
def stream_session(t):
    def build(s):
        g = s.withWatermark("ts", LATE).groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("value")).alias("total"))
        return g.select("user_id", F.unix_micros("w.start").alias("start"), "n", "total")
    return windows_of(t, "session", build)


def keyed(t, label, step):
    """Replay the parts through a processor that takes each user's rows in time order; the flush releases the last."""
    run, carry = step
    return windows_of(t, label, lambda s: in_time_order(s, "user_id", run, carry, LATE))


@query("stream_velocity", f"SELECT event_id, {r6('avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)')} AS mean_5 FROM events")
def stream_velocity(t):
    v = keyed(t, "velocity", last_mean(5))
    return v.select("event_id", rnd(F.when(~F.isnan("out"), F.col("out"))).alias("mean_5"))


@query("stream_threshold", "SELECT event_id, CAST(coalesce(count(*) OVER w >= 10 AND abs(value - avg(value) OVER w) > 3 * stddev_samp(value) OVER w, false) AS INT) AS alarm FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def stream_threshold(t):
    return keyed(t, "threshold", running_alarm(3.0, 10)).select("event_id", F.col("out").cast("int").alias("alarm"))


def third_sql(part):
    """Rows of one of the three time ranges that :func:`parts` replays."""
    return f"SELECT e.* FROM events e, (SELECT epoch_us(min(ts)) AS t0, epoch_us(max(ts)) AS t1 FROM events) WHERE least(floor((epoch_us(ts) - t0) * 3 / greatest(1, t1 - t0)), 2) = {part}"


_FIRST = third_sql(0)


@query("stream_drift", f"""WITH r AS ({_FIRST}), e AS (SELECT min(value) AS lo, max(value) AS hi FROM r), b AS (SELECT unnest(range(0, 10)) AS b), h AS (SELECT b, greatest((SELECT count(*) FROM r, e WHERE least(floor((value - lo) * 10 / (hi - lo)), 9) = b) / (SELECT count(*) FROM r), 1e-4::DOUBLE) AS p FROM b),
    d AS (SELECT CAST(epoch_us(date_trunc('day', ts)::TIMESTAMP) AS BIGINT) AS start, CASE WHEN value BETWEEN lo AND hi THEN least(floor((value - lo) * 10 / (hi - lo)), 9) END AS b FROM events, e), n AS (SELECT start, count(*) AS n FROM d GROUP BY 1), c AS (SELECT start, b, count(*) AS c FROM d GROUP BY 1, 2)
    SELECT n.start, {r6('sum((greatest(coalesce(c, 0) / n.n, 1e-4::DOUBLE) - p) * ln(greatest(coalesce(c, 0) / n.n, 1e-4::DOUBLE) / p))', 8)} AS psi FROM n CROSS JOIN h LEFT JOIN c ON c.start = n.start AND c.b = h.b GROUP BY 1""")
def stream_drift(t):
    """Daily histograms on bins frozen from the first third of the time span; the index is computed from the histogram table."""
    frozen = dr.frozen_bins(parts(t)[0], "value")
    edge = frozen.agg(F.max("lo").alias("lo"), F.max("hi").alias("hi")).first()
    bin_no = F.coalesce(dr.bin_of("value", F.lit(edge.lo), F.lit(edge.hi), 10), F.lit(-1))
    def build(s):
        g = s.withWatermark("ts", LATE).groupBy(F.window("ts", "1 day").alias("w"), bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
        return g.select(F.unix_micros("w.start").alias("start"), "bin", "c")
    hist = windows_of(t, "drift", build)
    n = hist.groupBy("start").agg(F.sum("c").alias("n"))
    ref = frozen.agg(F.collect_list(F.struct("bin", "ref_share"))).scalar()
    cells = n.withColumn("r", F.explode(ref)).select("start", "n", "r.bin", "r.ref_share").join(hist, ["start", "bin"], "left")
    return cells.groupBy("start").agg(rnd(F.sum(dr.psi_terms(F.col("ref_share"), F.coalesce("c", F.lit(0)) / F.col("n"))), 8).alias("psi"))


@query("stream_dedupe", "SELECT event_id, user_id FROM events")
def stream_dedupe(t):
    """Every tenth event arrives again in the next part and must pass once."""
    r = Replay(t.spark, "dedupe")
    ps = parts(t)
    for i, p in enumerate(ps):
        again = ps[i - 1].filter("event_id % 10 = 0") if i else p.limit(0)
        r.land(p.unionByName(again))
        r.run(lambda s: s.withWatermark("ts", "30 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id"))
    return r.result()


@query("stream_late", f"""WITH a AS ({third_sql(1)}), b AS ({third_sql(2)}), c AS ({third_sql(0)}), w AS (SELECT (SELECT max(ts) FROM a) - INTERVAL 1 HOUR AS wb, (SELECT max(ts) FROM (SELECT ts FROM a UNION ALL SELECT ts FROM b)) - INTERVAL 1 HOUR AS wc),
    r AS (SELECT event_id, ts, false AS late FROM a UNION ALL SELECT event_id, ts, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= wb FROM b, w UNION ALL SELECT event_id, ts, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= wc FROM c, w)
    SELECT late, CASE WHEN late THEN -1 ELSE CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) END AS start, CASE WHEN late THEN event_id ELSE -1 END AS event_id, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def stream_late(t):
    """The first part arrives last, behind the watermark: windows count the rows in time, late rows go to a table of their own."""
    r = Replay(t.spark, "late")
    ps = parts(t)
    each = late_split(t.spark, f"{r.root}/state", "ts", "1 hour", "1 hour", lambda d: d.groupBy("start").agg(F.count(F.lit(1)).alias("n")))
    for p in (ps[1], ps[2], ps[0]):
        r.land(p)
        r.run_batches(lambda s: s, each)
    kept = BatchState(t.spark, f"{r.root}/state/kept").all().groupBy("start").agg(F.sum("n").alias("n"))
    late = BatchState(t.spark, f"{r.root}/state/late").all()
    none = F.lit(-1).cast("bigint")
    return kept.select(F.lit(False).alias("late"), F.unix_micros("start").alias("start"), none.alias("event_id"), "n").unionByName(
        late.select(F.lit(True).alias("late"), none.alias("start"), "event_id", F.lit(1).cast("bigint").alias("n")))


@query("stream_score")
def stream_score(t):
    """A fitted pipeline scores arriving rows; decisions are appended to the log of the sink."""
    d, model = fitted(t)
    r = Replay(t.spark, "score")
    d = d.drop("treatment").withColumn("part", F.col("id") % 3)
    for i in range(3):
        r.land(d.filter(F.col("part") == i).drop("part"))
        r.run(lambda s: bd.decide(model.transform(s).select("id", p1().alias("p")), F.col("p"), 0.4, "v1").select("id", "probability", "prediction", "version"))
    return r.result().select("id", rnd("probability").alias("probability"), "prediction", "version")


def _online_sql(batches, rate=0.5, l1=1e-4, l2=1e-4):
    """The steps of :func:`online_steps` one after the other, a batch each."""
    d = "d AS (SELECT id, score, amount / 1e5::DOUBLE AS amount, CAST(y AS DOUBLE) AS y FROM v_scores)"
    steps = ["w0 AS (SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS s, 0.0::DOUBLE AS a)"]
    shrink = lambda g, w: f"sign({w} - {rate}::DOUBLE * {g}) * greatest(abs({w} - {rate}::DOUBLE * {g}) * {1 - rate * l2!r}::DOUBLE - {rate * l1!r}::DOUBLE, 0)"
    for i, cond in enumerate(batches):
        steps.append(f"g{i} AS (SELECT avg(e) AS gb, avg(e * score) AS gs, avg(e * amount) AS ga FROM (SELECT score, amount, 1 / (1 + exp(-(b + s * score + a * amount))) - y AS e FROM d, w{i} WHERE {cond}))")
        steps.append(f"w{i + 1} AS (SELECT b - {rate}::DOUBLE * gb AS b, {shrink('gs', 's')} AS s, {shrink('ga', 'a')} AS a FROM w{i}, g{i})")
    return ", ".join([d, *steps])


@query("stream_online_fit", f"WITH {_online_sql([f'id % 4 = {i}' for i in range(4)])} " + " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS batch, {r6('b', 7)} AS bias, {r6('s', 7)} AS w_score, {r6('a', 7)} AS w_amount FROM w{i + 1}" for i in range(4)))
def stream_online_fit(t):
    """Weights move with every micro-batch; they are stored by batch id, so a batch that runs again and a new session find them."""
    d = cls(t).select("id", "score", "amount", "y")
    r = Replay(t.spark, "fit")
    state = BatchState(t.spark, f"{r.root}/weights")
    for i in range(4):
        r.land(d.filter(F.col("id") % 4 == i))
        r.run_batches(lambda s: s, online_fit(state, ["score", "amount"], "y"))
    w = F.col("weights")
    return state.all().select(F.col("batch").cast("bigint").alias("batch"), rnd(w[0], 7).alias("bias"), rnd(w[1], 7).alias("w_score"), rnd(w[2], 7).alias("w_amount"))


def online_fit(state, cols, y):
    """A foreachBatch function: one step from the weights of the batch before, stored whole under the batch's own id."""
    def each(batch, batch_id):
        past = state.before(batch_id)
        w = np.array(past.first().weights) if past is not None else np.zeros(len(cols) + 1)
        if batch.limit(1).count():
            w = online_steps(batch, cols, y, w)
        state.write(batch_id, state.spark.createDataFrame([([float(v) for v in w],)], "weights array<double>").coalesce(1))

    return each
