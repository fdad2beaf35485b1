"""Drift and stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.operators.clean import attach_one

# PSI floor and its alert levels
PSI_FLOOR = 1e-4
PSI_LEVELS = [(0.25, "major"), (0.1, "moderate")]


def bin_of(value: str, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1 on [low, high], the last bin closed; NULL outside."""
    inside = (F.col(value) >= low) & (F.col(value) <= high)
    raw = F.floor((F.col(value) - low) * bins / F.nullif(high - low, F.lit(0.0)))
    return F.when(inside, F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).cast("int"))


def frozen_bins(reference: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, ref_share) of the reference with its range: the small table later data is compared with."""
    edge = reference.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("ref_n"))
    counts = attach_one(reference.select(value), edge).groupBy(bin_of(value, F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    all_bins = edge.select("lo", "hi", "ref_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return all_bins.join(counts, "bin", "left").select("bin", "lo", "hi", (F.coalesce("c", F.lit(0)) / F.col("ref_n")).alias("ref_share"))


def psi_terms(ref_share: Column, cur_share: Column) -> Column:
    r, c = F.greatest(ref_share, F.lit(PSI_FLOOR)), F.greatest(cur_share, F.lit(PSI_FLOOR))
    return (c - r) * F.ln(c / r)


def psi(reference: DataFrame, current: DataFrame, value: str, bins: int = 10, keys: list[str] | None = None) -> DataFrame:
    """Population stability index of ``current`` (per key) against ``reference``.

    Values outside the reference range keep their place in the denominator but fall in no bin.
    """
    keys = keys or []
    table = frozen_bins(reference, value, bins)
    edge = table.agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    cells = attach_one(current.select(*keys, value), edge).groupBy(*keys, bin_of(value, F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    shares = [F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("c"))), F.lit(0)) / F.sum("c") for i in range(bins)]
    wide = cells.groupBy(*keys).agg(*[s.alias(f"_b{i}") for i, s in enumerate(shares)])
    ref = table.agg(F.map_from_entries(F.collect_list(F.struct("bin", "ref_share")))).scalar()
    wide = wide.withColumn("_ref", ref)
    total = F.lit(0.0)
    for i in range(bins):
        total = total + psi_terms(F.col("_ref")[i], F.col(f"_b{i}"))
    return wide.select(*keys, total.alias("psi"))


def psi_level(value: Column) -> Column:
    out = F.when(value >= PSI_LEVELS[0][0], PSI_LEVELS[0][1])
    return out.when(value >= PSI_LEVELS[1][0], PSI_LEVELS[1][1]).otherwise("stable")
