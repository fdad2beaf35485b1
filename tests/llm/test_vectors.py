"""Neighbours and vector links against brute force."""

import math

import numpy as np
import pytest

from larkspur.llm import vectors
from larkspur.llm.vectors import nearest, vector_links

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, component_id int"


def table(seed=0, n=700, dims=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dims)).astype("float32")
    for i in range(0, 200, 2):
        base[i + 1] = base[i] + 0.1 * rng.standard_normal(dims)
    base[300:380] = base[300] + 0.12 * rng.standard_normal((80, dims))
    base[400:420] = base[400]
    rows = [(i * 5, base[i].tolist(), int(i % 3 if i >= 420 or i < 300 else 1), "x", 1) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * dims, [nan] * dims, [inf] + [0.0] * (dims - 1), [1.0] * (dims - 1), [None] + [1.0] * (dims - 1)]
    rows += [(100_000 + 100 * i, v, 1, "x", 1) for i, v in enumerate(odd)]
    rows += [(200_000, rows[0][1], None, "x", 1), (None, rows[0][1], 0, "x", 1), rows[5], rows[5]]
    return rows


def good(rows, dims=16):
    return [(i, np.array(v, float), lab) for i, v, lab, *_ in rows if i is not None and v is not None and len(v) == dims and None not in v and np.isfinite(v).all() and np.any(v)]


def test_nearest_finds_at_least_nine_tenths(spark):
    rows = table(n=3000)
    df = spark.createDataFrame(rows, SCHEMA)
    got = nearest(df, df.filter("vec_id % 100 = 0"), block_rows=400).collect()
    usable = good(rows)
    hits = total = 0
    for i, v, _ in usable:
        if i % 100:
            continue
        d = sorted({(float(np.sqrt(((v - w) ** 2).sum())), j) for j, w, _ in usable if j != i})[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [m[2] for m in mine] == sorted(m[2] for m in mine)
        exact = {j: float(np.sqrt(((v - w) ** 2).sum())) for j, w, _ in usable}
        assert all(math.isclose(exact[m[1]], m[2], rel_tol=1e-12, abs_tol=1e-12) for m in mine)
        hits += len({m[1] for m in mine} & {j for _, j in d})
        total += 10
    assert len({r.query_id for r in got}) == total // 10 and hits >= 0.9 * total


def test_nearest_after_a_beginning_of_copies(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.repeat(rng.standard_normal((1, 64)), 1000, 0), rng.standard_normal((3000, 64))]).astype("float32")
    df = spark.createDataFrame([(i, v.tolist(), 1, "x", 1) for i, v in enumerate(x)], SCHEMA).coalesce(1)
    asked = range(1000, 4000, 50)
    got = nearest(df, df.filter("vec_id >= 1000 and vec_id % 50 = 0")).collect()
    hits = 0
    for i in asked:
        d = ((x.astype(float) - x[i].astype(float)) ** 2).sum(1)
        d[i] = np.inf
        hits += len({r.vec_id for r in got if r.query_id == i} & set(np.lexsort((np.arange(len(d)), d))[:10].tolist()))
    assert hits >= 0.9 * 10 * len(asked)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0], 1, "x", 1), (100, [1.0, 2.0], 1, "x", 1), (3, [2.0, 2.0], 1, "x", 1), (2, [0.0, 2.0], 1, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, df.filter("vec_id % 100 = 0")).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0), (100, 1, 0, 0.0), (100, 2, 2, 1.0), (100, 3, 3, 1.0)]
    assert nearest(df.limit(0), df.limit(0)).count() == 0
    assert vector_links(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [1024, 16])
def test_vector_links(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE_ROWS", tile)
    rows = table()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_links(spark.createDataFrame(rows, SCHEMA)).collect()}
    ids = sorted({r[0] for r in rows if r[0] is not None})
    links = {i: set() for i in ids}
    usable = {i: (v / np.linalg.norm(v), lab) for i, v, lab in good(rows) if lab is not None}
    keys = sorted(usable)
    for a in range(len(keys)):
        for b in range(a):
            (v, l1), (w, l2) = usable[keys[a]], usable[keys[b]]
            if l1 == l2 and v @ w >= 0.93:
                links[keys[a]].add(keys[b])
                links[keys[b]].add(keys[a])
    root = {i: i for i in ids}
    for _ in range(50):
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in ids}
    assert sum(map(len, links.values())) > 3000
    assert sorted(got) == ids
    missed = [i for i in ids if got[i][0] != len(links[i])]
    assert len(missed) <= 0.01 * len(ids), missed
    assert all(got[i][0] <= len(links[i]) for i in ids)
    assert [i for i in ids if got[i][1] != root[i]] == []
    assert all(k == (i == c) for i, (_, c, k) in got.items())


def test_lengths_and_magnitudes(spark):
    """Every length is a space of its own; very large and very small vectors have a direction too."""
    rows = [(i, [1.0, 0.0, float(i)], 1) for i in range(6)] + [(10, [3.0, 4.0], 1), (11, [3.0, 4.0], 1), (12, [1e200, 0.0, 1.0], 2), (13, [1e200, 0.0, 2.0], 2),
            (14, [1e-200, 0.0, 1e-202], 2), (15, [1e-200, 0.0, 0.0], 2), (16, [1e-200, 1e-200, 0.0], 2), (20, [5.0], 1), (21, [-5.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_links(df).collect()}
    assert got[10] == (1, 10) and got[11] == (1, 10) and got[20] == (0, 20) and got[21] == (0, 21)
    assert [got[i] for i in (12, 13, 14, 15, 16)] == [(3, 12)] * 4 + [(0, 16)]
    near = [(r.query_id, r.rank, r.vec_id) for r in nearest(df, df.filter("vec_id in (10, 20, 3)"), 2).collect()]
    assert {q: sorted((k, v) for p, k, v in near if p == q) for q in (10, 20, 3)} == {10: [(1, 11)], 20: [(1, 21)], 3: [(1, 2), (2, 4)]}
