"""Range sums and time windows against brute force, on both sizes of groups."""

import math

from pyspark.sql import functions as F

from larkspur.operators.windows import over_time, range_sums

ROWS = [(None, "a", 1, 1.0), (None, "a", 3, 2.0), (7, "a", 4, float("nan")), (7, "a", 4, 1e300), (8, "a", 30, 5.0), (9, "a", 31, 0.25), (10, "a", 35, float("inf")), (11, "a", 60, 1.0),
        (12, "a", 61, 2.0), (13, "a", None, 9.0), (14, None, 5, 4.0), (14, None, 7, 6.0), (15, "b", -3, 1e17), (16, "b", 6, 3.0), (17, "b", 8, 1.0), (18, "b", 16, 1.0)]
SCHEMA = "event_id bigint, k string, clock bigint, x double"


def expected(span):
    out = []
    for i, k, t, x in ROWS:
        near = [r[3] for r in ROWS if r[1] == k and (r[2] is None if t is None else r[2] is not None and t - span <= r[2] <= t - 1)]
        out.append((str(i), str(k), str(t), str(x), str(len(near)), str(math.fsum(near)) if all(map(math.isfinite, near)) else str(sum(near))))
    return sorted(out)


def sums(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = range_sums(df, "event_id", ["k"], "clock", {"n": (10, F.lit(1).cast("bigint")), "s": (10, F.col("x")), "n30": (30, F.lit(1).cast("bigint"))}).collect()
    assert sorted((str(r.event_id), str(r.k), str(r.clock), str(r.n30)) for r in got) == sorted((i, k, t, n) for i, k, t, _, n, _ in expected(30))
    return sorted((str(r.event_id), str(r.k), str(r.clock), str(r.x), str(r.n), str(r.s)) for r in got)


def test_range_sums(spark):
    assert sums(spark) == expected(10)


def test_range_sums_of_large_groups(spark, small_groups):
    spark.conf.set("spark.larkspur.maxGroupRows", "2")
    assert sums(spark) == expected(10)


def test_over_time_keeps_rows_without_a_clock(spark, small_groups):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = over_time(df, ["k"], "clock", 10, lambda w: {"n": F.count("x").over(w.rangeBetween(-10, 0))})
    assert got.count() == len(ROWS) and [r.n for r in got.filter("clock is null").collect()] == [1]


BIG = 2 ** 53
SERIES = [(i, "ab"[i % 2] if i % 5 else None, None if i % 7 == 0 else BIG + (i * 37) % 101, float(i % 4) if i % 3 else None) for i in range(60)]


def plain_and_ranged(spark, make):
    rows = {}
    for limit in ("8", None):
        if limit:
            spark.conf.set("spark.larkspur.maxGroupRows", limit)
        else:
            spark.conf.unset("spark.larkspur.maxGroupRows")
        rows[limit] = sorted(map(str, make(spark.createDataFrame(SERIES, "id bigint, k string, t bigint, x double")).collect()))
    return rows["8"], rows[None]


def brute_running(i, back=False):
    """Rows of the series up to row i, newest last."""
    key = lambda r: (r[2] is not None, r[2] or 0, r[0])
    own = [r for r in SERIES if r[1] == SERIES[i][1]]
    return sorted((r for r in own if (key(r) >= key(SERIES[i]) if back else key(r) <= key(SERIES[i]))), key=key, reverse=back)


def test_running_keeps_null_orders_and_large_integers(spark):
    from larkspur.operators.windows import running
    items = {"n": ("count", F.col("x")), "s": ("sum", F.col("x")), "m": ("max", F.col("x")), "f": ("last", F.col("x"))}
    for descending in (False, True):
        cut, plain = plain_and_ranged(spark, lambda df: running(df, ["k"], "t", "id", items, descending=descending))
        assert cut == plain and len(cut) == len(SERIES)
        for r in running(spark.createDataFrame(SERIES, "id bigint, k string, t bigint, x double"), ["k"], "t", "id", items, descending=descending).collect():
            seen = [v[3] for v in brute_running(r.id, descending) if v[3] is not None]
            assert (r.n, r.s or 0, r.f) == (len(seen), sum(seen), seen[-1] if seen else None)


def test_frames_keep_null_orders_and_large_integers(spark):
    from larkspur.operators.windows import over_rows
    lags = lambda w: {"a": F.lag("id", 3).over(w), "b": F.lead("id", 2).over(w), "s": F.sum("x").over(w.rowsBetween(-4, -1))}
    cut, plain = plain_and_ranged(spark, lambda df: over_rows(df, ["k"], "t", "id", lags, before=4, after=2))
    assert cut == plain and len(cut) == len(SERIES)


def test_asof_with_null_clocks_keys_and_ties(spark):
    from larkspur.operators.joins import asof
    right = [(k, BIG + t, v) for k in ("a", "b", None) for t in (10, 10, 50, 51, 90) for v in (1, 2)] + [("a", None, 5)]

    def match(df):
        return asof(df, spark.createDataFrame(right, "k string, u bigint, v int"), ["k"], "t", "u", ["v"])

    cut, plain = plain_and_ranged(spark, match)
    assert cut == plain and len(cut) == len(SERIES)
    got = {r.id: r for r in match(spark.createDataFrame(SERIES, "id bigint, k string, t bigint, x double")).collect()}
    for i, k, t, _ in SERIES:
        past = [u for k2, u, _ in right if k is not None and k2 == k and u is not None and t is not None and u <= t]
        assert (got[i].r_clock, got[i].r_v) == ((max(past), 2) if past else (None, None))


def test_numbered_keeps_null_orders_and_cuts_shared_values(spark):
    from larkspur.operators.prefix import numbered
    from larkspur.operators.split import group_kfold, kfold, stratified_split, time_blocks
    df = spark.createDataFrame(SERIES, "id bigint, k string, t bigint, x double")
    for descending in (False, True):
        got = numbered(df, "t", "id", ["k"], "n", descending).collect()
        for k in ("a", "b", None):
            own = sorted((r for r in got if r.k == k), key=lambda r: r.n)
            assert [r.n for r in own] == list(range(1, len(own) + 1)) and {r.n_total for r in own} == {len(own)}
            clocks = [r.t for r in own]
            want = sorted((c for c in clocks if c is not None), reverse=descending)
            nulls = [None] * clocks.count(None)
            assert clocks == (want + nulls if descending else nulls + want)
    holes = df.withColumn("id", F.expr("CASE WHEN id % 6 > 0 THEN id END"))
    for out in (stratified_split(holes, "id", "k"), kfold(holes, "id", 5), kfold(holes, "id", 5, ["k"]), time_blocks(df, "t", "id", 4)):
        assert out.count() == len(SERIES)
    many = spark.range(20_000).selectExpr("id AS g")
    folds = group_kfold(many, "g").groupBy("fold").count().collect()
    assert {r["count"] for r in folds} == {4000}
