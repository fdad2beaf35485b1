"""Stored, mergeable sketches: one row per day and key, so a new day is added without reading the others again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def add_days(df: DataFrame, path: str, day: str, keys: Sequence[str], distinct: str, value: str, lgk: int = 12, k: int = 800) -> None:
    """Sketch each day of ``df``: distinct values of one column (HLL), quantiles of another (KLL); appended by day.

    A day that is already stored is replaced.  Nulls enter neither sketch; a day without values has a null one.
    """
    days = df.withColumn("day", F.to_date(day)).groupBy("day", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(distinct), F.lit(lgk)).alias("hll"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("kll"))
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def _read(spark: SparkSession, path: str, first, last) -> DataFrame:
    days = spark.read.parquet(path)
    if first is not None:
        days = days.filter(F.col("day") >= F.lit(first))
    return days.filter(F.col("day") <= F.lit(last)) if last is not None else days


def distinct_between(spark: SparkSession, path: str, keys: Sequence[str], first=None, last=None) -> DataFrame:
    """(keys, n, distinct): distinct values over the days, from the stored sketches alone."""
    return _read(spark, path, first, last).groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("distinct"))


def quantiles_between(spark: SparkSession, path: str, keys: Sequence[str], probs: Sequence[float], first=None, last=None) -> DataFrame:
    """(keys, p, value): quantiles over the days.  Sketches of a key are merged one by one: as many as there are days."""
    held = _read(spark, path, first, last).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "kll"))).alias("s"))
    whole = F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.get("s", F.lit(0))["kll"], lambda a, x: F.kll_sketch_merge_double(a, x["kll"]))
    held = held.select(*keys, whole.alias("kll"))
    at = [F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("kll", F.lit(float(p))).alias("value")) for p in probs]
    return held.select(*keys, F.inline(F.array(*at)))
