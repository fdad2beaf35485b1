"""Running totals, ranks and exact quantiles over orders too long for one task.

A window without ``partitionBy`` (or one over a key that holds a third of the table) pulls that whole
order into a single task.  Here every global order is handled in two passes:

1. rows are first reduced to one row per (keys, value), so copies of a hot value never travel;
2. the values are cut into ordered slices, each slice is summed, the slice totals (at most
   ``slices`` rows per key) give each slice its start offset, and the running sum inside a slice is
   an ordinary window partitioned by (keys, slice).

The slice edges come from ``approxQuantile``; they decide only balance, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from larkspur.session import cut, n_buckets


def slice_edges(df: DataFrame, order: str, slices: int | None = None) -> list[float]:
    """Inner edges that cut ``order`` into about equal slices (bounded by the slice count)."""
    n = slices or n_buckets(df.sparkSession)
    probs = [i / n for i in range(1, n)]
    found = df.approxQuantile(order, probs, 0.5 / n)
    return sorted(set(found))


def with_slice(df: DataFrame, order: str, edges: Sequence[float], name: str = "_slice") -> DataFrame:
    """Ordered slice number of each row; monotone in ``order``."""
    if not edges:
        return df.withColumn(name, F.lit(0))
    splits = [-float("inf"), *edges, float("inf")]
    cutter = Bucketizer(splits=splits, inputCol=order, outputCol=name, handleInvalid="keep")
    return cutter.transform(df).withColumn(name, F.col(name).cast("int"))


def global_cumsum(
    df: DataFrame,
    order: str,
    values: dict[str, Column],
    keys: Sequence[str] = (),
    descending: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """One row per (keys, order) with ``v`` (own sum), ``cum_v`` (inclusive) and ``tot_v`` per value.

    ``values`` maps a name to the expression to add up.  ``order`` must be numeric.
    """
    keys = list(keys)
    names = list(values)
    flat = df.filter(F.col(order).isNotNull()).groupBy(*keys, F.col(order).cast("double").alias(order)).agg(
        *[F.sum(expr).alias(name) for name, expr in values.items()]
    )
    edges = slice_edges(df.select(F.col(order).cast("double").alias(order)), order, slices)
    flat = with_slice(flat, order, edges)
    by_slice = flat.groupBy(*keys, "_slice").agg(*[F.sum(v).alias(f"_s_{v}") for v in names])
    slot = F.col("_slice").desc() if descending else F.col("_slice").asc()
    earlier = W.partitionBy(*keys).orderBy(slot).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = by_slice.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_o_slice"),
        *[F.coalesce(F.sum(f"_s_{v}").over(earlier), F.lit(0)).alias(f"_off_{v}") for v in names],
        *[F.sum(f"_s_{v}").over(whole).alias(f"tot_{v}") for v in names],
    )
    cond = F.col("_slice") == F.col("_o_slice")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    place = F.col(order).desc() if descending else F.col(order).asc()
    inside = W.partitionBy(*keys, "_slice").orderBy(place).rowsBetween(W.unboundedPreceding, 0)
    return flat.join(offsets, cond).select(
        *keys,
        order,
        *names,
        *[(F.col(f"_off_{v}") + F.sum(v).over(inside)).alias(f"cum_{v}") for v in names],
        *[f"tot_{v}" for v in names],
    )


#: Slices used to narrow an order statistic down: more slices, fewer candidate rows to sort.
PICK_SLICES = 64


def pick_ranks(
    df: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]], by: Sequence[str] = ()
) -> DataFrame:
    """Exact order statistics: per group the value at each 1-based rank (a function of the group's size).

    Counting rows per value slice tells which slice holds each wanted rank; only the rows of those
    slices (about ranks / slices of the data) are shuffled and sorted, after copies were combined.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    edges = slice_edges(rows, "_v", max(PICK_SLICES, n_buckets(df.sparkSession)))
    sliced = with_slice(rows, "_v", edges)
    sizes = sliced.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in by], F.col("_slice").alias("_o_slice"), "_n",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"), F.sum("_n").over(W.partitionBy(*by)).alias("_tot"))
    wanted = F.lit(False)
    for rank in ranks.values():
        at = rank(F.col("_tot"))
        wanted = wanted | ((at > F.col("_off")) & (at <= F.col("_off") + F.col("_n")))
    cond = F.col("_slice") == F.col("_o_slice")
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    near = sliced.join(sizes.filter(wanted), cond).groupBy(*by, "_slice", "_off", "_tot", "_v").agg(F.count(F.lit(1)).alias("_c"))
    inside = W.partitionBy(*by, "_slice").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    near = near.withColumn("_cum", F.col("_off") + F.sum("_c").over(inside))
    picks = [
        F.max(F.when((F.col("_cum") >= rank(F.col("_tot"))) & (F.col("_cum") - F.col("_c") < rank(F.col("_tot"))), F.col("_v"))).alias(name)
        for name, rank in ranks.items()
    ]
    return near.groupBy(*by).agg(*picks, F.max("_tot").alias("tot_n"))


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated quantiles (one column per name in ``probs``), per ``by`` group or overall.

    Unlike the built-in ``percentile`` no aggregation buffer ever holds a group's distinct values.
    """
    by = list(by)

    def place(p: float, total: Column) -> Column:
        return F.lit(float(p)) * (total - 1)

    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in probs.items():
        ranks[f"_lo_{name}"] = lambda total, p=p: F.floor(place(p, total)) + 1
        ranks[f"_hi_{name}"] = lambda total, p=p: F.ceil(place(p, total)) + 1
    picked = pick_ranks(df, value, ranks, by)

    def between(name: str, p: float) -> Column:
        low, high, at = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), place(p, F.col("tot_n"))
        return (low + (high - low) * (at - F.floor(at))).alias(name)

    return picked.select(*by, *[between(n, p) for n, p in probs.items()])


def average_rank(df: DataFrame, value: str, keys: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Per (keys, value): average rank of its ties and the group's count."""
    cum = global_cumsum(df, value, {"n": F.lit(1).cast("bigint")}, keys, descending)
    return cum.select(
        *keys, value, "n",
        (F.col("cum_n") - (F.col("n") - 1) / F.lit(2.0)).alias("avg_rank"),
        F.col("tot_n"),
    )


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_slice") -> DataFrame:
    """``df`` sorted into ranges of (keys, order) and stored, with the range's number as ``name``.

    Ranges are cut by Spark over the columns' own types: a series too long for a task is many ranges, rows alike in all
    columns share one, and null orders come first, as in an ascending window.
    """
    return cut(df.repartitionByRange(n_buckets(df.sparkSession), *keys, *order).withColumn(name, F.spark_partition_id()))


def same_keys(keys: Sequence[str], prefix: str = "_k_") -> Column:
    """Null-safe equality of ``keys`` with their copies."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return cond


def numbered(
    df: DataFrame, order: str, tie: str | Sequence[str], keys: Sequence[str] = (), name: str = "rn", descending: bool = False
) -> DataFrame:
    """``row_number`` over (keys) ordered by (order, tie), and the group's size as ``{name}_total``; no task holds a whole order.

    ``descending`` turns ``order`` only.  Rows with a null key, order or tie are numbered as a window numbers them:
    nulls first, and last where ``order`` descends.  A value that very many rows share is cut by the tie.
    """
    keys = list(keys)
    ties = [tie] if isinstance(tie, str) else list(tie)
    if descending:
        # ranges ascend: the order is turned by its type's own descending sort
        stored = cut(df.repartitionByRange(n_buckets(df.sparkSession), *keys, F.col(order).desc(), *ties).withColumn("_slice", F.spark_partition_id()))
    else:
        stored = ranged(df, keys, [order, *ties])
    sizes = stored.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_o_slice"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
        F.sum("_n").over(W.partitionBy(*keys)).alias("_group_n"),
    )
    first = F.col(order).desc() if descending else F.col(order)
    inside = W.partitionBy(*keys, "_slice").orderBy(first, *ties)
    return (
        stored.join(offsets, (F.col("_slice") == F.col("_o_slice")) & same_keys(keys))
        .withColumn(name, (F.col("_off") + F.row_number().over(inside)).cast("bigint"))
        .drop("_slice", "_o_slice", "_off", *[f"_k_{k}" for k in keys])
        .withColumnRenamed("_group_n", f"{name}_total")
    )
