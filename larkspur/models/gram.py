"""Linear fits from cross-product (Gram) matrices: folds by subtraction, penalty paths without another pass, pooled segments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def _cells(cols: Sequence[str], y: str) -> list[Column]:
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in cols], F.col(y).cast("double")]
    return [z[i] * z[j] for i in range(len(z)) for j in range(i, len(z))]


def _square(flat: Sequence[float], d: int) -> np.ndarray:
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = flat
    return out + np.triu(out, 1).T


def fold_grams(df: DataFrame, cols: Sequence[str], y: str, folds: Sequence[str]) -> dict[tuple, np.ndarray]:
    """Gram matrix of (1, cols, y) for every combination of ``folds``: one job, one row a combination.  Rows with nulls take no part."""
    rows = df.dropna(subset=[*cols, y])
    cells = _cells(cols, y)
    made = rows.groupBy(*folds).agg(*[F.sum(c).alias(f"c{i}") for i, c in enumerate(cells)]).collect()
    return {tuple(r[f] for f in folds): _square([r[f"c{i}"] for i in range(len(cells))], len(cols) + 2) for r in made}


def ridge_from_gram(g: np.ndarray, penalty: float) -> np.ndarray:
    """(bias, weights): least squares with ``penalty`` times the squared weights of the standardised columns, per row.

    Means and deviations come from the same matrix, so the scaling is fitted on the same rows as the weights.  A column
    without variance gets weight 0.
    """
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov)[:-1], 0, None))
    live = sd > 1e-9 * np.maximum(1.0, np.abs(mean[:-1]))
    w = np.zeros(len(sd))
    if live.any():
        c = cov[:-1, :-1][np.ix_(live, live)] / np.outer(sd[live], sd[live])
        w[live] = np.linalg.solve(c + penalty * np.eye(live.sum()), cov[:-1, -1][live] / sd[live]) / sd[live]
    return np.concatenate([[mean[-1] - w @ mean[:-1]], w])


def squared_error(g: np.ndarray, w: np.ndarray) -> float:
    """Sum of squared errors of (bias, weights) over the rows behind ``g``."""
    v = np.append(w, -1.0)
    return float(v @ g @ v)


def ridge_path(grams: dict[tuple, np.ndarray], penalties: Sequence[float]) -> list[tuple[float, float]]:
    """(penalty, cross-validated RMSE): each fold predicted by the fit of all others, whose matrix is the total less its own."""
    total = sum(grams.values())
    n = total[0, 0]
    return [(p, float(np.sqrt(sum(squared_error(g, ridge_from_gram(total - g, p)) for g in grams.values()) / n))) for p in penalties]


def nested_ridge(grams: dict[tuple, np.ndarray], penalties: Sequence[float]) -> list[tuple[int, float, float]]:
    """(outer fold, chosen penalty, RMSE on the fold) from matrices by (outer, inner): the penalty is chosen without the outer fold."""
    out = []
    for o in sorted({k[0] for k in grams}):
        inner: dict[tuple, np.ndarray] = {}
        for (a, b), g in grams.items():
            if a != o:
                inner[(b,)] = inner.get((b,), 0) + g
        best = min(ridge_path(inner, penalties), key=lambda r: (r[1], r[0]))[0]
        test = sum(g for (a, _), g in grams.items() if a == o)
        out.append((o, best, float(np.sqrt(squared_error(test, ridge_from_gram(sum(inner.values()), best)) / test[0, 0]))))
    return out


def pooled_segments(df: DataFrame, segment: str, cols: Sequence[str], y: str, prior: float = 20.0) -> DataFrame:
    """(segment, weights): (bias, weights) of each segment, pulled towards the fit over all rows as by ``prior`` rows of it.

    A thin segment, or one whose columns do not vary, so has a fit of its own near the global one, and never a null.  The
    row with segment null and ``is_all`` true holds the global fit, for segments that were not seen; a null segment is one.
    """
    rows = df.dropna(subset=[*cols, y])
    d = len(cols) + 2
    cells = F.array(*[F.sum(c) for c in _cells(cols, y)])
    grams = rows.groupBy(F.col(segment).alias("segment")).agg(cells.alias("g"))
    whole = rows.agg(cells.alias("g")).first()
    if whole.g[0] is None:
        return grams.select("segment", F.lit(False).alias("is_all"), F.array().cast("array<double>").alias("weights"))
    total = _square(whole.g, d)
    scale = np.sqrt(np.diag(total)[:-1] / total[0, 0])
    scale[scale == 0] = 1.0
    share = total[:-1, :-1] / total[0, 0] / np.outer(scale, scale)
    base = np.linalg.lstsq(share, total[:-1, -1] / total[0, 0] / scale, rcond=None)[0]

    @F.pandas_udf("array<double>")
    def solve(g: pd.Series) -> pd.Series:
        out = []
        for flat in g:
            m = _square(flat, d)
            a = m[:-1, :-1] / np.outer(scale, scale) + prior * share
            out.append((np.linalg.lstsq(a, m[:-1, -1] / scale + prior * share @ base, rcond=None)[0] / scale).tolist())
        return pd.Series(out)

    own = grams.select("segment", F.lit(False).alias("is_all"), solve("g").alias("weights"))
    kind = df.schema[segment].dataType.simpleString()
    everyone = df.sparkSession.createDataFrame([(True, (base / scale).tolist())], "is_all boolean, weights array<double>")
    return own.unionByName(everyone.select(F.lit(None).cast(kind).alias("segment"), "is_all", "weights"))


def predict_segments(df: DataFrame, model: DataFrame, segment: str, cols: Sequence[str], out: str) -> DataFrame:
    """Add the prediction of each row's segment, or of all rows where the segment was not seen."""
    own = model.filter(~F.col("is_all")).select(F.col("segment").alias("_segment"), F.col("weights").alias("_own"))
    everyone = model.filter("is_all").agg(F.first("weights")).scalar()
    joined = df.join(own, F.col(segment).eqNullSafe(F.col("_segment")), "left").withColumn("_w", F.coalesce("_own", everyone))
    value = F.get("_w", F.lit(0))
    for i, c in enumerate(cols):
        value = value + F.get("_w", F.lit(i + 1)) * F.col(c)
    return joined.withColumn(out, value).drop("_segment", "_own", "_w")
