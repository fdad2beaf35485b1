"""Censored-time metrics without risk-set joins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.operators.prefix import global_cumsum

def one() -> Column:
    return F.lit(1).cast("bigint")


def kaplan_meier(df: DataFrame, duration: str, event: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, duration, at_risk, events, survival); the product is a running sum of logs."""
    keys = list(keys)
    t = global_cumsum(df, duration, {"n": one(), "d": F.col(event).cast("bigint")}, keys, descending=True)
    t = t.select(*keys, duration, F.col("cum_n").alias("at_risk"), F.col("d").alias("events"))
    gone = F.col("events") >= F.col("at_risk")
    step = F.when(gone, 0.0).otherwise(F.ln(1 - F.col("events") / F.col("at_risk")))
    s = global_cumsum(t, duration, {"at_risk": F.col("at_risk"), "events": F.col("events"), "step": step, "gone": gone.cast("bigint")}, keys)
    return s.select(*keys, duration, "at_risk", "events", F.when(F.col("cum_gone") > 0, 0.0).otherwise(F.exp("cum_step")).alias("survival"))


def concordance(df: DataFrame, duration: str, event: str, risk: str) -> DataFrame:
    """Share of comparable pairs (event at the earlier time) in which the earlier one has the higher risk; ties count half.

    Pairs are never formed.  Write each time as its rank in binary: two times differ first at exactly
    one bit, so each pair is counted at one level, where it shares the higher bits (the cell) and the
    earlier time has bit 0, the later bit 1.  Per cell one prefix sum over risk counts the pairs: n log n.
    """
    rows = df.groupBy(F.col(duration).cast("double").alias("_t"), F.col(risk).cast("double").alias("_r")).agg(
        F.sum(event).cast("bigint").alias("_e"), F.count(F.lit(1)).alias("_n"))
    times = rows.select("_t").distinct()
    ranks = global_cumsum(times, "_t", {"one": one()}).select(F.col("_t").alias("_t2"), (F.col("cum_one") - 1).alias("_rank"))
    levels = max(1, math.ceil(math.log2(max(2, times.count()))))
    cells = rows.join(ranks, F.col("_t") == F.col("_t2")).withColumn("_lvl", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    cells = cells.withColumn("_cell", F.expr("shiftright(_rank, _lvl + 1)")).withColumn("_late", F.expr("cast(shiftright(_rank, _lvl) as bigint) & 1"))
    s = global_cumsum(cells, "_r", {
        "a": F.when(F.col("_late") == 0, F.col("_e")).otherwise(0), "c": F.when(F.col("_late") == 1, F.col("_n")).otherwise(0)}, ["_lvl", "_cell"])
    return s.agg(
        F.sum(F.col("a") * F.col("tot_c")).alias("comparable"),
        F.sum(F.col("a") * (F.col("cum_c") - F.col("c"))).alias("concordant"),
        F.sum(F.col("a") * F.col("c")).alias("tied"),
    ).withColumn("c_index", (F.col("concordant") + F.col("tied") / F.lit(2.0)) / F.col("comparable"))
