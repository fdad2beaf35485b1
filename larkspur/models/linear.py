"""Linear models whose every step is one distributed aggregate and a d x d solve on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from larkspur.operators.prefix import global_cumsum


def dot(cols: Sequence[str], w: Sequence[float], bias: float = 0.0) -> Column:
    out = F.lit(float(bias))
    for c, v in zip(cols, w):
        out = out + F.col(c) * F.lit(float(v))
    return out


def cross_products(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Matrix of sum(a * b) over all column pairs: one pass, one row comes back."""
    d = len(cols)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = df.agg(*[F.sum(F.col(cols[i]).cast("double") * F.col(cols[j]).cast("double")) for i, j in pairs]).first()
    out = np.zeros((d, d))
    for (i, j), v in zip(pairs, row):
        out[i, j] = out[j, i] = v
    return out


def normal_equation(df: DataFrame, cols: Sequence[str], y: str) -> np.ndarray:
    """(bias, weights) of least squares from sums of cross-products, with centred columns for accuracy."""
    means = df.agg(*[F.avg(c) for c in [*cols, y]]).first()
    centred = df.select(*[(F.col(c) - F.lit(m)).alias(c) for c, m in zip([*cols, y], means)])
    m = cross_products(centred, [*cols, y])
    w = np.linalg.solve(m[:-1, :-1], m[:-1, -1])
    return np.concatenate([[means[-1] - float(np.dot(w, means[:-1]))], w])


def gradient_descent(
    df: DataFrame, cols: Sequence[str], y: str, rate: float = 0.1, steps: int = 50, link: str = "identity", l2: float = 0.0, history: list | None = None
) -> np.ndarray:
    """Batch gradient descent on standardised columns; each step is one aggregate over the cached rows.

    ``link``: identity (mean squared error), logit (log loss) or hinge (y in -1/1).
    """
    w, b = np.zeros(len(cols)), 0.0
    cached = df.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(y).cast("double").alias(y)).cache()
    for _ in range(steps):
        z = dot(cols, w, b)
        t = F.col(y)
        if link == "logit":
            p = 1 / (1 + F.exp(-z))
            err, q = p - t, F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
            loss = -(t * F.ln(q) + (1 - t) * F.ln(1 - q))
        elif link == "hinge":
            bad = t * z < 1
            err, loss = F.when(bad, -t).otherwise(0.0), F.greatest(1 - t * z, F.lit(0.0))
        else:
            err, loss = 2 * (z - t), (z - t) * (z - t)
        row = cached.agg(F.avg(err), F.avg(loss), *[F.avg(err * F.col(c)) for c in cols]).first()
        if history is not None:
            history.append(row[1])
        b -= rate * row[0]
        w = w - rate * (np.array(row[2:], dtype=float) + l2 * w)
    cached.unpersist()
    return np.concatenate([[b], w])


def quantile_fit(df: DataFrame, cols: Sequence[str], y: str, qs: Sequence[float], steps: int = 30) -> list[np.ndarray]:
    """Pinball-loss fits for several quantiles at once by reweighted least squares.

    |e| is replaced by e^2 / (2 |e_old|) around the last fit; each step is one aggregate that carries the
    cross-products of every quantile, followed by d x d solves.
    """
    names = [None, *cols]
    d = len(names)
    term = lambda i: F.lit(1.0) if names[i] is None else F.col(names[i])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    start = normal_equation(df, cols, y)
    scale = df.agg(F.stddev_pop(y)).first()[0]
    fits = [np.array(start) for _ in qs]
    for step in range(steps):
        floor = max(scale * 0.5 ** (step + 1), scale * 1e-4)
        aggs, weights = [], {}
        for k, (q, w) in enumerate(zip(qs, fits)):
            e = F.col(y) - dot(cols, w[1:], w[0])
            weights[f"_w{k}"] = F.when(e >= 0, q).otherwise(1 - q) / F.greatest(F.abs(e), F.lit(floor))
            weight = F.col(f"_w{k}")
            aggs += [F.sum(weight * term(i) * term(j)) for i, j in pairs] + [F.sum(weight * term(i) * F.col(y)) for i in range(d)]
        row = [float(v) for v in df.withColumns(weights).agg(*aggs).first()]
        size, moved = len(pairs) + d, 0.0
        for k in range(len(qs)):
            part = row[k * size:(k + 1) * size]
            a = np.zeros((d, d))
            for (i, j), v in zip(pairs, part):
                a[i, j] = a[j, i] = v
            new = np.linalg.solve(a, np.array(part[len(pairs):]))
            moved = max(moved, float(np.abs(new - fits[k]).max()))
            fits[k] = new
        if moved < scale * 1e-3 and floor <= scale * 1e-2:
            break
    return fits


def cox_fit(df: DataFrame, cols: Sequence[str], duration: str, event: str, l2: float = 0.01, steps: int = 8) -> np.ndarray:
    """Cox weights by Newton steps on the Breslow likelihood.

    Each step needs, per event time, the sums of r, r x and r x x' over everyone still at risk: suffix
    sums over time, taken with the two-pass prefix sum, so no risk set is ever gathered.
    """
    d = len(cols)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    beta = np.zeros(d)
    base = df.select(F.col(duration).cast("double").alias("_t"), F.col(event).cast("bigint").alias("_e"), *[F.col(c).cast("double").alias(c) for c in cols]).cache()
    n_events = base.agg(F.sum("_e")).first()[0]
    for _ in range(steps):
        r = F.exp(dot(cols, beta))
        sums = {"e": F.col("_e"), "r": r}
        sums.update({f"x{i}": r * F.col(c) for i, c in enumerate(cols)})
        sums.update({f"v{i}_{j}": r * F.col(cols[i]) * F.col(cols[j]) for i, j in pairs})
        sums.update({f"s{i}": F.col("_e") * F.col(c) for i, c in enumerate(cols)})
        t = global_cumsum(base, "_t", sums, descending=True)
        mean = [F.col(f"cum_x{i}") / F.col("cum_r") for i in range(d)]
        grad = [F.sum(F.col(f"s{i}") - F.col("e") * mean[i]) for i in range(d)]
        hess = [F.sum(F.col("e") * (F.col(f"cum_v{i}_{j}") / F.col("cum_r") - mean[i] * mean[j])) for i, j in pairs]
        row = t.agg(*grad, *hess).first()
        g = np.array(row[:d], dtype=float) / n_events - l2 * beta
        h = np.zeros((d, d))
        for (i, j), v in zip(pairs, row[d:]):
            h[i, j] = h[j, i] = v / n_events
        step = np.linalg.solve(h + l2 * np.eye(d), g)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    base.unpersist()
    return beta
