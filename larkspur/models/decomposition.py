"""Covariance and principal components from partial cross-product matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from larkspur.operators.cluster import centre_means


def covariance(df: DataFrame, dims: int, vec: str = "vec") -> tuple[DataFrame, list[float], int]:
    """(long table i, j, cov; means; rows): sample covariance.

    Each task multiplies its own centred batches and emits one d x d partial; partials are summed by cell.
    """
    stats = centre_means(df.withColumn("_all", F.lit(0)), "_all", dims, vec).first()
    mean, n = np.array(stats["mean"], dtype=float), stats.n

    def partial(batches):
        acc = np.zeros((dims, dims))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float) - mean
                acc += x.T @ x
        i, j = np.indices((dims, dims))
        yield pd.DataFrame({"i": i.ravel().astype("int32"), "j": j.ravel().astype("int32"), "s": acc.ravel()})

    cells = df.select(F.col(vec).cast("array<double>").alias("v")).mapInPandas(partial, "i int, j int, s double")
    return cells.groupBy("i", "j").agg((F.sum("s") / (n - 1)).alias("cov")), list(mean), n


class Pca:
    """Fitted components: rows of ``components`` are unit vectors, strongest first, largest loading positive."""

    def __init__(self, mean, components, variance):
        self.mean, self.components, self.variance = mean, components, variance

    @property
    def ratio(self) -> np.ndarray:
        return self.variance / self.variance.sum()

    def n_for(self, share: float) -> int:
        return int(np.searchsorted(np.cumsum(self.ratio), share - 1e-12) + 1)

    def transform(self, df: DataFrame, k: int, vec: str = "vec", out: str = "pc") -> DataFrame:
        mean, comp = np.array(self.mean), self.components[:k]

        @F.pandas_udf("array<double>")
        def project(v: pd.Series) -> pd.Series:
            return pd.Series(list((np.stack(v.to_numpy()).astype(float) - mean) @ comp.T))

        return df.withColumn(out, project(vec))

    def inverse(self, df: DataFrame, k: int, pc: str = "pc", out: str = "rebuilt") -> DataFrame:
        mean, comp = np.array(self.mean), self.components[:k]

        @F.pandas_udf("array<double>")
        def back(v: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(v.to_numpy()) @ comp + mean))

        return df.withColumn(out, back(pc))


def fit_pca(df: DataFrame, dims: int, vec: str = "vec") -> Pca:
    """Eigen pairs of the d x d covariance, solved on the driver."""
    cov, mean, _ = covariance(df, dims, vec)
    m = np.zeros((dims, dims))
    for r in cov.collect():
        m[r.i, r.j] = r.cov
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    order = values.argsort()[::-1]
    comp = vectors[:, order].T
    for row in comp:
        if row[np.abs(row).argmax()] < 0:
            row *= -1
    return Pca(mean, comp, np.maximum(values[order], 0))
