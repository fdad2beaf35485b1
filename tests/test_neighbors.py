"""Boxes of a block against all pairs."""

import numpy as np
import pandas as pd
import pytest

from larkspur.operators import neighbors as nn


def points(n, dims, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).round(1)  # many ties and copies
    x[: n // 4] = x[0]
    return pd.DataFrame({"id": np.arange(n, dtype="int64"), "vec": list(x), "tag": rng.integers(0, 50, n).astype(float)})


@pytest.mark.parametrize("metric,rule,radius", [("l2", "any", np.inf), ("l2", "not_self", 0.3), ("l2", "earlier", np.inf), ("l1", "other_tag", np.inf), ("l1", "not_self", 0.2)])
def test_boxes_find_what_all_pairs_find(monkeypatch, metric, rule, radius):
    base, queries = points(900, 3, 1), points(300, 3, 2)
    want = nn._top_of_all(queries, base, 4, metric, rule, radius)
    pairs, all_of = [], nn._top_of_all
    monkeypatch.setattr(nn, "_BOX", 16)
    monkeypatch.setattr(nn, "_top_of_all", lambda q, b, *a: pairs.append(len(q) * len(b)) or all_of(q, b, *a))
    got = nn._top(queries, base, 4, metric, rule, radius)
    order = ["qid", "dist", "bid"]
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True))
    # the first queries in order have fewer earlier points than asked for: nothing bounds their search
    assert rule == "earlier" or sum(pairs) < 0.6 * len(base) * len(queries)


@pytest.mark.parametrize("metric,rule,radius", [("l2", "any", np.inf), ("l2", "not_self", 4.0), ("l2", "earlier", np.inf), ("l1", "other_tag", np.inf), ("l1", "not_self", 14.0), ("l1", "earlier", np.inf)])
def test_streamed_parts_find_what_all_pairs_find(spark, monkeypatch, metric, rule, radius):
    from pyspark.sql import functions as F
    base, queries = points(900, 20, 1), points(700, 20, 1)
    base.loc[5, "vec"][:] = np.nan
    queries.loc[6, "vec"][3] = 1e6  # beyond every scale
    want = nn._top_of_all(queries, base.drop(index=5), 6, metric, rule, radius)
    plain, sizes, one = nn._search_parts, [], lambda d: spark.createDataFrame(d.assign(vec=d["vec"].map(list)), "id long, vec array<double>, tag double")
    monkeypatch.setattr(nn, "_FIRST_ROWS", 8)
    monkeypatch.setattr(nn, "_search_parts", lambda *a: sizes.append(a[2]) or plain(*a))
    got = nn.knn(one(queries), one(base), 6, "id", "id", metric=metric, rule=rule, radius=radius, qtag=F.col("tag"), btag=F.col("tag"), block_rows=64)
    order = ["qid", "dist", "bid"]
    found = got.toPandas()
    assert sizes and (found.groupby("qid")["rn"].max() == found.groupby("qid").size()).all()
    pd.testing.assert_frame_equal(found[["qid", "bid", "dist"]].sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True))


def test_streamed_search_writes_no_hits_per_block(spark):
    from pyspark.sql import functions as F
    rows = spark.range(2000).select("id", F.transform(F.sequence(F.lit(1), F.lit(16)), lambda j: F.rand(3) + j * 0).alias("vec"))
    hits = nn.knn(rows, rows, 5, "id", "id", rule="not_self", block_rows=100)
    rows_in = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" not in rows_in and "MapInArrow" in rows_in and hits.count() == 10_000


def test_bounds_name_every_pair_within_reach():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(400, 64)), rng.normal(size=(50, 64)) * 1000, rng.normal(size=(50, 64)) * 1e-3]) + 30
    ids = np.arange(500)
    for metric in ("l2", "l1"):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) if metric == "l2" else np.abs(x[:, None] - x[None]).sum(2)
        tau = np.sort(d, axis=1)[:, 7]
        part = nn._Part(ids, x, ids * 0.0, tau, [[0]] * 500, 5, metric, "any", np.inf)
        named = np.zeros(d.shape, bool)
        for rows, cols in getattr(part, f"_near_{metric}")(ids, x):
            named[rows, cols] = True
        assert named[d <= tau[:, None]].all() and named[:400].mean() < .2


def test_unit_vectors_take_their_norm_once(spark):
    from pyspark.sql import functions as F
    from larkspur.plans.vectors import unit_vector
    made = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, vec array<double>").select("id", unit_vector(F.col("vec")).alias("u"))
    assert {r.id: r.u for r in made.collect()} == {1: [.6, .8], 2: [None, None]}
    # the norm stands in front of the vector's own lambda, not in it
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") == 1 and "array(SQRT(aggregate(" in plan


def test_base_rows_are_sent_once_per_part_and_hits_are_final(spark, monkeypatch):
    from pyspark.sql import functions as F
    rows = spark.range(3000).select("id", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda j: F.xxhash64("id", j) / F.lit(2.0 ** 63)).alias("vec"))
    found, plain = [], nn._search_parts
    monkeypatch.setattr(nn, "_search_parts", lambda *a: found.append((a[4], plain(*a))) or found[-1][1])
    nn.knn(rows, rows, 50, "id", "id", rule="not_self", block_rows=100)
    (part_rows, hits), = found
    # 60 cells of 100 rows: a block's own 50 hits a query would be up to 60 x 150,000
    assert part_rows == 400 and hits.count() == 3000 * 50 and hits.groupBy("qid").count().filter("count <> 50").count() == 0
