"""Inverted lists against brute force."""

import numpy as np

from larkspur.operators.inverted import build_lists

SCHEMA = "id bigint, vec array<double>"


def table(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], SCHEMA)


def true_neighbours(x, asked, k):
    d = ((x[asked][:, None] - x[None]) ** 2).sum(-1)
    d[np.arange(len(asked)), asked] = np.inf
    return {int(a): set(np.argsort(r, kind="stable")[:k].tolist()) for a, r in zip(asked, d)}


def test_recall_and_cost_on_clustered_and_shapeless_rows(spark, small_groups):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16)) * 5
    clustered = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16))
    shapeless = rng.normal(size=(1500, 16))
    copies = np.concatenate([np.repeat(shapeless[:1], 1000, axis=0) + rng.normal(size=(1000, 16)) * 1e-3, shapeless])
    for x, most in ((clustered, .5), (shapeless, 1.0), (copies, 1.0)):
        df = table(spark, x)
        asked = np.arange(0, len(x), 20)
        index = build_lists(df, "id", recall=.97)
        found = {}
        for r in index.search(df.filter("id % 20 = 0"), "id", 10).collect():
            found.setdefault(r.qid, []).append((r["rank"], r.bid, r.dist))
        true = true_neighbours(x, asked, 10)
        assert sum(len(true[q] & {b for _, b, _ in found[q]}) for q in true) >= .9 * 10 * len(asked)
        for q, rows in found.items():
            rows.sort()
            assert [r[0] for r in rows] == list(range(1, 11)) and [r[2] for r in rows] == sorted(r[2] for r in rows) and q not in {b for _, b, _ in rows}
            assert all(abs(d - np.sqrt(((x[q] - x[b]) ** 2).sum())) < 1e-9 for _, b, d in rows)
        cost = index.candidates(df.filter("id % 20 = 0"), "id").agg({"candidates": "avg"}).first()[0]
        assert cost <= most * len(x)


def test_nulls_ties_few_rows_and_empty(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [3.0, 4.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = build_lists(df, "id", recall=1.0).search(df, "id", 3).orderBy("qid", "rank").collect()
    assert [(r.qid, r.bid, r.dist) for r in got if r.qid < 4] == [(1, 2, 0.0), (1, 3, 0.0), (1, 5, 5.0), (2, 1, 0.0), (2, 3, 0.0), (2, 5, 5.0), (3, 1, 0.0), (3, 2, 0.0), (3, 5, 5.0)]
    assert {r.qid for r in got} == {1, 2, 3, 5}
    none = df.filter("false")
    assert build_lists(none, "id").search(df, "id", 3).count() == 0
