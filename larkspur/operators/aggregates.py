"""Aggregate tables: profiles, correlations, entropies, shrinkage, hierarchies, sensors, spectra."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement
from math import pi

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from larkspur.operators.clean import attach_one
from larkspur.operators.prefix import exact_quantiles
from larkspur.operators.windows import group_values, over_rows, running


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, nulls, null share, distinct, min, max, mean.

    Cells are reduced to (column, value, count) before anything is counted, so a hot value is one row.
    """
    def cell(f: T.StructField) -> Column:
        c = F.col(f.name)
        num = c.cast("double") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")
        return F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                        c.cast("string").alias("v"), num.alias("x"))

    cells = df.select(F.inline(F.array(*[cell(f) for f in df.schema.fields])))
    counts = cells.groupBy("column", "dtype", "v", "x").count()
    return counts.groupBy("column", "dtype").agg(
        F.sum("count").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("count"))), F.lit(0)).alias("n_null"),
        F.count("v").alias("n_distinct"), F.min("x").alias("min"), F.max("x").alias("max"),
        (F.sum(F.col("x") * F.col("count")) / F.sum(F.when(F.col("x").isNotNull(), F.col("count")))).alias("mean"),
    )


def value_counts(df: DataFrame, c: str) -> DataFrame:
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def pair_matrix(df: DataFrame, cols: Sequence[str], fn=F.corr) -> DataFrame:
    """All column pairs (a <= b by position) of a two-column aggregate in one pass, long form."""
    pairs = list(combinations_with_replacement(cols, 2))
    wide = df.agg(*[fn(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("v")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(cells))


def target_corr(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Correlation of every column with the target, one pass, strongest first."""
    wide = df.agg(*[F.corr(c, target).alias(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in cols])
    return wide.select(F.inline(cells)).orderBy(F.abs("corr").desc(), "feature")


def corr_drop(df: DataFrame, cols: Sequence[str], limit: float = 0.9) -> list[str]:
    """Columns to drop so no kept pair correlates above ``limit`` (walks the d x d table only)."""
    dropped: list[str] = []
    for r in pair_matrix(df, cols).filter((F.col("a") != F.col("b")) & (F.abs("v") > limit)).collect():
        if r.a not in dropped and r.b not in dropped:
            dropped.append(r.b)
    return dropped


def modal_value(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """Most frequent value per key (ties to the smallest) with its count and the key's total."""
    counts = df.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys).agg(F.max("n").alias("_top"), F.sum("n").alias("total"))
    return (counts.join(best, list(keys)).filter(F.col("n") == F.col("_top"))
            .groupBy(*keys, "total").agg(F.min(c).alias("mode"), F.max("n").alias("n")))


def entropy(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """Shannon entropy (nats) of ``c`` per key: ln N - sum(n ln n) / N from the counts alone."""
    counts = df.groupBy(*keys, c).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return counts.groupBy(*keys).agg(
        (F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("entropy"), F.count(F.lit(1)).alias("n_values"))


def shrink(df: DataFrame, unit: str, group: str, value: str, k: float) -> DataFrame:
    """(n * own mean + k * group mean) / (n + k) per unit."""
    own = df.groupBy(group, unit).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    means = own.groupBy(F.col(group).alias("_g")).agg((F.sum("s") / F.sum("n")).alias("group_mean"))
    joined = own.join(means, F.col(group) == F.col("_g")).drop("_g")
    return joined.withColumn("shrunk", (F.col("s") + k * F.col("group_mean")) / (F.col("n") + k))


def rollup_levels(df: DataFrame, levels: Sequence[str], value: str) -> DataFrame:
    """Bottom-up totals at every level of a hierarchy, from the cell totals (one reduction of the rows)."""
    cells = df.groupBy(*levels).agg(F.sum(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    return cells.rollup(*levels).agg(F.grouping_id().alias("level"), F.sum("_v").alias("total"), F.sum("_n").alias("n"))


def sensor_features(df: DataFrame, keys: Sequence[str], order: str, tie: str, x: str) -> DataFrame:
    """Per series: location, spread, quantiles, slope, thirds' means, spikes and rates of change."""
    keys = list(keys)
    base = df.select(*keys, order, tie, x)
    stats = {"_m": F.avg(x), "_s": F.stddev_pop(x), "_n": F.count(F.lit(1))}
    rows = running(base, keys, order, tie, {"_i": ("count", F.lit(1))})
    rows = over_rows(rows, keys, order, tie, lambda w: {"_prev": F.lag(x).over(w)}, before=1)
    rows = group_values(rows, keys, stats)
    i, third = F.col("_i") - 1, F.floor(F.col("_n") / 3)
    spike = F.abs(x) > F.col("_m") + 2 * F.col("_s")
    step = F.abs(F.col(x) - F.col("_prev"))
    feats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        (F.max(x) - F.min(x)).alias("range"), F.regr_slope(F.col(x), i.cast("double")).alias("slope"),
        F.avg(F.when(i < third, F.col(x))).alias("phase1"),
        F.avg(F.when((i >= third) & (i < 2 * third), F.col(x))).alias("phase2"),
        F.avg(F.when(i >= 2 * third, F.col(x))).alias("phase3"),
        F.sum(spike.cast("int")).alias("spikes"), F.max(step).alias("max_step"), F.avg(step).alias("mean_step"))
    quants = exact_quantiles(base, x, {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}, keys)
    return feats.join(quants, keys)


def spectral_features(df: DataFrame, keys: Sequence[str], order: str, tie: str, x: str, frame: int | None = None, high_from: int = 30) -> DataFrame:
    """DFT magnitudes of each whole series: dominant bin, energy, high-frequency share.

    Every reading meets all n/2 + 1 frequencies of its series of n; the products are summed map-side per (series, k).
    With ``frame``, consecutive frames of that many readings are transformed instead (column ``frame``): the work
    is bounded by frame/2 + 1 frequencies a reading, but no longer period can be seen.
    """
    keys = list(keys)
    rows = running(df.select(*keys, order, tie, x), keys, order, tie, {"_i": ("count", F.lit(1))})
    rows = rows.withColumn("_t", F.col("_i") - 1)
    if frame:
        rows = rows.withColumn("frame", F.floor(F.col("_t") / frame)).withColumn("_t", F.col("_t") % frame)
    series = [*keys, "frame"] if frame else keys
    rows = group_values(rows, series, {"_n": F.count(F.lit(1))})
    waves = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") / 2).cast("int"))))
    # k * t modulo n leaves the angle as it is and keeps it small: long series lose no digits
    angle = F.lit(2 * pi) * (F.col("k") * F.col("_t") % F.col("_n")) / F.col("_n")
    mags = waves.groupBy(*series, "k").agg(
        F.sqrt(F.pow(F.sum(F.col(x) * F.cos(angle)), 2) + F.pow(F.sum(F.col(x) * F.sin(angle)), 2)).alias("mag"))
    return mags.groupBy(*series).agg(
        F.max_by("k", F.when(F.col("k") > 0, F.struct(F.round("mag", 6), -F.col("k")))).alias("dominant"),
        F.sum(F.pow("mag", 2)).alias("energy"),
        (F.sum(F.when(F.col("k") >= high_from, F.col("mag")).otherwise(0.0)) / (F.sum("mag") + 1e-10)).alias("high_share"))


def detrend(df: DataFrame, period: str, value: str) -> DataFrame:
    """Fit a line through the period means and subtract it."""
    means = df.groupBy(period).agg(F.avg(value).alias("_m"))
    line = means.agg(F.regr_slope("_m", F.col(period)).alias("slope"), F.regr_intercept("_m", F.col(period)).alias("intercept"))
    out = attach_one(df, line)
    return out.withColumn("detrended", F.col(value) - (F.col("intercept") + F.col("slope") * F.col(period)))


def cooccurrence(df: DataFrame, key: str, tags: str) -> DataFrame:
    """Pair counts and lift of tags per document: pairs come from each row's own tag set, no self join."""
    rows = df.select(key, F.array_sort(F.array_distinct(tags)).alias("_t")).filter(F.size("_t") > 0)
    total = rows.agg(F.count(F.lit(1)).cast("double")).scalar()
    single = rows.select(F.explode("_t").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = rows.select(F.posexplode("_t").alias("p", "a"), "_t").select("a", F.explode(F.expr("slice(_t, p + 2, size(_t))")).alias("b"))
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab"))
    return (counts.join(single.select(F.col("tag").alias("a"), F.col("n").alias("n_a")), "a")
            .join(single.select(F.col("tag").alias("b"), F.col("n").alias("n_b")), "b")
            .withColumn("lift", F.col("n_ab") * total / (F.col("n_a") * F.col("n_b"))))


def croston(df: DataFrame, keys: Sequence[str], order: str, x: str, alpha: float = 0.1) -> DataFrame:
    """Intermittent-demand forecast per series.

    The exponential recursion is a weighted sum with weights known from each step's index, so a series
    is an aggregate and never a collected list.
    """
    keys = list(keys)
    pos = running(df.select(*keys, order, x), keys, order, order, {"_t": ("count", F.lit(1))}).filter(F.col(x) > 0)
    pos = running(pos, keys, order, order, {"_j": ("count", F.lit(1))})
    pos = over_rows(pos, keys, order, order, lambda w: {"_next": F.lead("_t").over(w)}, after=1)
    pos = group_values(pos, keys, {"_n": F.count(F.lit(1))})
    i, m = F.col("_j") - 1, F.col("_n") - 1
    keep = F.pow(F.lit(1 - alpha), m - 1 - i)
    weight = F.when(i == 0, keep).otherwise(alpha * keep)
    smooth = pos.filter(F.col("_next").isNotNull()).groupBy(*keys).agg(
        (F.sum(weight * F.col(x)) / F.sum(weight * (F.col("_next") - F.col("_t")))).alias("_f"))
    means = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.sum((F.col(x) > 0).cast("int")).alias("n_demand"))
    return means.join(smooth, keys, "left").select(*keys, "n_demand", F.coalesce("_f", "_m").alias("forecast"))
