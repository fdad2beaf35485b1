"""Metric tables that are plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.functions.scalar import ratio
from larkspur.operators.clean import quantile_bins
from larkspur.operators.prefix import exact_quantiles


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_report(conf: DataFrame) -> DataFrame:
    """Per class precision, recall, F1 and support from a confusion table (classes x classes, not rows)."""
    actual = conf.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    called = conf.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("called"))
    r = actual.join(called, "cls", "left").fillna(0, ["called"])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return r.select("cls", "support", "tp", "called", zero(ratio("tp", "called")).alias("precision"), zero(ratio("tp", "support")).alias("recall"),
                    zero(ratio(2 * F.col("tp"), F.col("called") + F.col("support"))).alias("f1"))


def binary_rates(y: str, pred: str) -> dict[str, Column]:
    """Rates of a 0/1 prediction as aggregate expressions."""
    tp, fp = F.sum(F.col(y) * F.col(pred)), F.sum((1 - F.col(y)) * F.col(pred))
    fn, tn = F.sum(F.col(y) * (1 - F.col(pred))), F.sum((1 - F.col(y)) * (1 - F.col(pred)))
    return {"flagged": F.avg(F.col(pred).cast("double")), "rate": F.avg(F.col(y).cast("double")), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
            "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, tp + fn)}


def fbeta(precision: Column, recall: Column, beta: float) -> Column:
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * precision * recall, b * precision + recall), F.lit(0.0))


def log_loss(p: str, y: str) -> Column:
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    return -F.avg(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))


def calibration(df: DataFrame, p: str, y: str, k: int, by_quantile: bool = False) -> DataFrame:
    """Bin, n, mean prediction, observed rate, gap; uniform bins or quantile bins."""
    if by_quantile:
        b = quantile_bins(df, p, k, "bin")
    else:
        b = df.withColumn("bin", F.least(F.floor(F.col(p) * k), F.lit(k - 1)).cast("int"))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate")).withColumn("gap", F.abs(F.col("mean_p") - F.col("rate")))


def regression_metrics(y: str, p: str) -> dict[str, Column]:
    e = F.col(p) - F.col(y)
    return {"mse": F.avg(e * e), "rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)), "bias": F.avg(e),
            "r2": 1 - F.sum(e * e) / (F.var_pop(y) * F.count(y)),
            "rmsle": F.sqrt(F.avg(F.pow(F.log1p(p) - F.log1p(y), 2)))}


def percent_metrics(y: str, p: str, tolerance: float) -> dict[str, Column]:
    e = F.abs(F.col(p) - F.col(y))
    rel = F.try_divide(e, F.abs(y))
    return {"mape": F.avg(rel), "smape": F.avg(F.try_divide(2 * e, F.abs(y) + F.abs(p))), "wape": F.sum(e) / F.sum(F.abs(y)),
            "within": F.avg((rel <= tolerance).cast("double"))}


def pinball(y: str, p: Column, q: float) -> Column:
    e = F.col(y) - p
    return F.avg(F.greatest(q * e, (q - 1) * e))


def pair_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of two labelings, from their contingency table."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n"))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    xlogx = F.sum(F.col("n") * F.ln("n"))
    c = cells.agg(F.struct(pairs.alias("p"), F.sum("n").alias("n"), xlogx.alias("x")).alias("c"))
    r = rows.agg(F.struct(pairs.alias("p"), xlogx.alias("x")))
    k = cols.agg(F.struct(pairs.alias("p"), xlogx.alias("x")))
    out = c.withColumns({"r": r.scalar(), "k": k.scalar()})
    n = F.col("c.n")
    expected = F.col("r.p") * F.col("k.p") / (n * (n - 1) / 2)
    ha, hb, hab = F.ln(n) - F.col("r.x") / n, F.ln(n) - F.col("k.x") / n, F.ln(n) - F.col("c.x") / n
    return out.select(F.try_divide(F.col("c.p") - expected, (F.col("r.p") + F.col("k.p")) / 2 - expected).alias("ari"),
                      F.try_divide(ha + hb - hab, (ha + hb) / 2).alias("nmi"))


def kappa_quadratic(conf: DataFrame, k: int) -> DataFrame:
    """Quadratic weighted kappa from a confusion table with integer classes."""
    w = F.pow(F.col("actual") - F.col("predicted"), 2) / float((k - 1) ** 2)
    a = conf.groupBy("actual").agg(F.sum("n").alias("na"))
    p = conf.groupBy("predicted").agg(F.sum("n").alias("np"))
    # expected disagreement from the marginals' moments: E(i - j)^2 = E i^2 + E j^2 - 2 E i E j
    def moments(m, c, n):
        return m.agg(F.struct((F.sum(F.col(c) * F.col(n)) / F.sum(n)).alias("m1"), (F.sum(F.col(c) * F.col(c) * F.col(n)) / F.sum(n)).alias("m2")))
    out = conf.agg((F.sum(w * F.col("n")) / F.sum("n")).alias("obs")).withColumns({"a": moments(a, "actual", "na").scalar(), "p": moments(p, "predicted", "np").scalar()})
    exp = (F.col("a.m2") + F.col("p.m2") - 2 * F.col("a.m1") * F.col("p.m1")) / float((k - 1) ** 2)
    return out.select((1 - F.col("obs") / exp).alias("qwk"))
