"""Whitening against numpy over Python integers."""

import math
import random

import numpy as np
import pytest

from larkspur.llm.whitening import whiten, whitening_report

SCHEMA = "vec_id bigint, embedding array<float>, label int, n string, deviation string, x int"


def rows_of(vectors, ids=None):
    return [((ids or range(len(vectors)))[i], v, 0, "theirs", "theirs", 1) for i, v in enumerate(vectors)]


def brute(vectors, weighted=False):
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors]
    fit = x if weighted else sorted(set(x))
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    c = np.array(fit, float) - np.array([t / n for t in s])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    white = [(np.array(v, float) - np.array([t / n for t in s])) @ u[:, :4] / np.sqrt(e[:4]) for v in x]
    return n, [sum((n * v[i] - s[i]) ** 2 for i in range(d)) for v in x], white, e[:4] / e.sum()


@pytest.mark.parametrize("weights", ["one", "count"])
def test_against_numpy(spark, weights):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 12)) * np.linspace(0.2, 3, 12)).astype(np.float32).tolist()
    vectors += [vectors[0]] * 150 + vectors[5:40]
    n, deviation, white, explained = brute(vectors, weights == "count")
    got = {r.vec_id: r for r in whiten(spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(5), weights=weights).collect()}
    assert sorted(got) == list(range(len(vectors)))
    sign = np.sign(np.array(got[0].whitened) * white[0])
    for i, v in enumerate(white):
        assert got[i].n == n and got[i].deviation == deviation[i]
        assert np.allclose(np.array(got[i].whitened) * sign, v, atol=1e-9)
        assert np.allclose(got[i].explained, explained, rtol=1e-10)
        assert got[i].identity_error < 1e-9


def test_unusable_vectors_ties_and_repeated_ids(spark):
    good = [[1.0, 2.0], [1.0, 2.0], [3.0, -1.0], [0.25, 0.5], [-0.0, 0.0]]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0]]
    rows = rows_of(good + bad, [7, 7, None, 3, 4, 5, 6, 8, 9, 10])
    out = whitening_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in out) == sorted((i is None, i or 0, c) for i in [7, 7, None, 3, 4] for c in (1, 2))
    assert {r.n for r in out} == {4}
    n, deviation, _, _ = brute(good)
    assert {r.vec_id: r.deviation for r in out}[7] == deviation[0] and n == 4


def test_lengths_are_spaces_of_their_own(spark):
    rng = random.Random(1)
    two = [[rng.gauss(0, 1), rng.gauss(0, 2)] for _ in range(30)]
    three = [[rng.gauss(0, 1), rng.gauss(0, 2), rng.gauss(0, 3)] for _ in range(20)]
    out = whiten(spark.createDataFrame(rows_of(two + three), SCHEMA)).collect()
    for r in out:
        n, deviation, _, _ = brute(two if r.vec_id < 30 else three)
        assert (r.n, r.deviation) == (n, deviation[r.vec_id % 30])
        assert len(r.whitened) == (2 if r.vec_id < 30 else 3) and r.identity_error < 1e-9


def test_no_variance_large_numbers_and_empty(spark):
    same = whitening_report(spark.createDataFrame(rows_of([[1.0, 2.0]] * 3), SCHEMA)).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, 0.0, 0.0, 0.0)} and len(same) == 6
    large = whiten(spark.createDataFrame(rows_of([[1e30, 0.0], [-1e30, 3.0], [2e6, 1.0]]), SCHEMA)).collect()
    assert len(large) == 3 and any(r.deviation is None for r in large)
    assert whitening_report(spark.createDataFrame([], SCHEMA)).count() == 0
