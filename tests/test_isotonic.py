"""Isotonic fits in slices against the one-pass fit."""

import numpy as np
import pytest

from larkspur.models import isotonic as iso


def one_pass(x, y):
    order = np.argsort(x, kind="stable")
    ux, at = np.unique(x[order], return_index=True)
    s, n = np.add.reduceat(y[order], at), np.diff(np.append(at, len(x)))
    start = iso.pool(s, n.astype(float))
    level = np.add.reduceat(s, start) / np.add.reduceat(n, start)
    return ux, np.repeat(level, np.diff(np.append(start, len(ux))))


@pytest.mark.parametrize("kind", ["noisy", "falling", "rising"])
def test_slices_equal_one_pass(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3000, 6000) / 7
    y = {"noisy": x / 400 + rng.normal(0, 1, 6000), "falling": -x, "rising": x * 1.0}[kind]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id int, x double, y double")
    blocks = iso.isotonic_blocks(df, "x", "y", slice_blocks=250)
    got = {r.id: r.p for r in iso.isotonic_apply(df, blocks, "x", "p").collect()}
    ux, level = one_pass(x, y)
    assert np.allclose([got[i] for i in range(len(x))], level[np.searchsorted(ux, x)], atol=1e-9)
    means = [r.s / r.w for r in blocks.orderBy("low").collect()]
    assert all(a < b for a, b in zip(means, means[1:]))


def test_a_million_scores(spark):
    rows = spark.range(1_000_000).selectExpr("double(id) AS x", "double(id) / 100000 + double((id * 7919) % 10007) / 10007 AS y")
    blocks = iso.isotonic_blocks(rows, "x", "y", slice_blocks=100_000)
    i = np.arange(1_000_000)
    y = i / 100000 + (i * 7919 % 10007) / 10007
    start = iso.pool(y, np.ones(len(y)))
    got = blocks.orderBy("low").toPandas()
    assert got.low.astype(int).tolist() == start.tolist() and np.allclose(got.s / got.w, np.add.reduceat(y, start) / np.diff(np.append(start, len(y))))


def test_between_beyond_nulls_and_empty(spark):
    df = spark.createDataFrame([(0.0, 0.0, 9), (2.0, 1.0, 9), (None, 5.0, 9), (3.0, None, 9)], "x double, y double, side int")
    blocks = iso.isotonic_blocks(df, "x", "y")
    ask = spark.createDataFrame([(-1.0, 1), (0.5, 2), (2.0, 3), (7.0, 4), (None, 5)], "x double, side int")
    got = {r.side: r.p for r in iso.isotonic_apply(ask, blocks, "x", "p").collect()}
    assert got == {1: 0.0, 2: 0.25, 3: 1.0, 4: 1.0, 5: None}
    none = iso.isotonic_blocks(df.filter("false"), "x", "y")
    assert [r.p for r in iso.isotonic_apply(ask, none, "x", "p").collect()] == [None] * 5
