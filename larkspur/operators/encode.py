"""Leak-free encoders: every one learns from train rows only (or from the other folds)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.operators.clean import attach_one
from larkspur.operators.prefix import exact_quantiles


def frequency_encode(df: DataFrame, c: str, train: Column, out: str) -> DataFrame:
    """Share of the value among train rows, unseen values 0."""
    base = df.filter(train)
    freq = base.groupBy(F.col(c).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    total = base.agg(F.count(F.lit(1)).cast("double")).scalar()
    return df.join(freq, F.col(c) == F.col("_k"), "left").withColumn(out, F.coalesce(F.col("_n") / total, F.lit(0.0))).drop("_k", "_n")


def target_encode(df: DataFrame, c: str, y: str, train: Column, out: str, smoothing: float = 10.0, form: str = "m") -> DataFrame:
    """Smoothed target mean of the train rows; ``m`` weighs by n/(n+a), ``sigmoid`` by 1/(1+exp(a-n))."""
    base = df.filter(train)
    stats = base.groupBy(F.col(c).alias("_k")).agg(F.count(y).alias("_n"), F.avg(y).alias("_m"))
    overall = base.agg(F.avg(y)).scalar()
    n, a = F.col("_n"), F.lit(float(smoothing))
    w = n / (n + a) if form == "m" else 1 / (1 + F.exp(a - n))
    joined = df.join(stats, F.col(c) == F.col("_k"), "left").withColumn("_g", overall)
    return joined.withColumn(out, F.coalesce(w * F.col("_m") + (1 - w) * F.col("_g"), F.col("_g"))).drop("_k", "_n", "_m", "_g")


def target_encode_oof(df: DataFrame, c: str, y: str, fold: str, out: str, smoothing: float = 10.0) -> DataFrame:
    """Each fold encoded from the other folds: totals minus the fold's own sums, one small join."""
    cells = df.groupBy(F.col(c).alias("_k"), F.col(fold).alias("_f")).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    value = cells.groupBy(F.col("_k").alias("_k2")).agg(F.sum("_s").alias("_vs"), F.sum("_n").alias("_vn"))
    folds = cells.groupBy(F.col("_f").alias("_f2")).agg(F.sum("_s").alias("_fs"), F.sum("_n").alias("_fn"))
    whole = folds.agg(F.sum("_fs").alias("_ts"), F.sum("_fn").alias("_tn"))
    folds = attach_one(folds, whole).select("_f2", ((F.col("_ts") - F.col("_fs")) / (F.col("_tn") - F.col("_fn"))).alias("_rest"))
    table = cells.join(value, F.col("_k").eqNullSafe(F.col("_k2"))).join(folds, F.col("_f").eqNullSafe(F.col("_f2")))
    n = F.col("_vn") - F.col("_n")
    # sums of a category without a known target are null: it gets the rest's mean
    enc = (F.coalesce("_vs", F.lit(0.0)) - F.coalesce("_s", F.lit(0.0)) + smoothing * F.col("_rest")) / (n + smoothing)
    table = table.select("_k", "_f", enc.alias(out))
    return df.join(table, F.col(c).eqNullSafe(F.col("_k")) & F.col(fold).eqNullSafe(F.col("_f")), "left").drop("_k", "_f")


def signed_hash(cols: Sequence[str], crosses: Sequence[Sequence[str]], dims: int) -> Column:
    """Hashed categorical features as array<struct<index, value>>; value is the hash sign."""
    names = [(c, F.concat_ws("=", F.lit(c), F.col(c).cast("string"))) for c in cols]
    names += [("x".join(x), F.concat_ws("=", F.lit("x".join(x)), F.concat_ws("_", *[F.col(c).cast("string") for c in x]))) for x in crosses]
    cells = []
    for _, text in names:
        h = F.xxhash64(text)
        cells.append(F.struct(F.pmod(h, F.lit(dims)).cast("int").alias("index"), F.when(F.shiftright(h, 63) < 0, -1.0).otherwise(1.0).alias("value")))
    return F.array(*cells)


def standard_scale(df: DataFrame, cols: Sequence[str], train: Column) -> DataFrame:
    """Centre and divide by the population deviation of the train rows."""
    base = df.filter(train)
    stats = base.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    out = attach_one(df, stats)
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c in cols}).drop(*stats.columns)


def robust_scale(df: DataFrame, cols: Sequence[str], train: Column) -> DataFrame:
    """Centre on the median and divide by the interquartile range of the train rows."""
    out = df
    for c in cols:
        q = exact_quantiles(df.filter(train), c, {"_q1": .25, "_q2": .5, "_q3": .75})
        out = attach_one(out, q).withColumn(c, (F.col(c) - F.col("_q2")) / F.nullif(F.col("_q3") - F.col("_q1"), F.lit(0.0))).drop("_q1", "_q2", "_q3")
    return out


def mutual_info(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mutual information (nats) of each discrete feature with the target, all features in one pass.

    Uses H(X) + H(Y) - H(X, Y) with entropies from joint counts, so only counts are shuffled.
    """
    keys = list(keys)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("x")) for c in features])
    joint = df.select(*keys, F.col(target).cast("string").alias("y"), F.inline(cells)).groupBy(*keys, "feature", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    by = [*keys, "feature"]

    def part(cols, name):
        sums = joint.groupBy(*by, *cols).agg(F.sum("n").alias("n"))
        return sums.groupBy(*by).agg(F.sum(F.col("n") * F.ln("n")).alias(name), F.sum("n").alias(f"t_{name}"))

    out = part(["x", "y"], "xy").join(part(["x"], "x"), by).join(part(["y"], "y"), by)
    n = F.col("t_xy")
    return out.select(*by, (F.ln(n) + (F.col("xy") - F.col("x") - F.col("y")) / n).alias("mi"))


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """Balanced weight n / (k * n_c) per class."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("weight", counts.agg(F.sum("n") / F.count(F.lit(1))).scalar() / F.col("n"))
