"""Isotonic regression over more scores than one task holds: adjacent violators are pooled slice by slice.

Rows are first reduced to one per score.  Each ordered slice pools its own violators into blocks; pooling commutes, so what
the slices leave can be cut anew, at other borders and into fewer slices, and pooled again, until no two neighbouring
blocks violate the order.  A task holds one slice of blocks, never all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from larkspur.operators.windows import running
from larkspur.session import cut, release

#: Blocks that one task pools
SLICE_BLOCKS = 1_000_000


def pool(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """First position of each pooled block, for sums ``s`` and weights ``w`` in the order of the score."""
    starts: list[int] = []
    sums: list[float] = []
    weights: list[float] = []
    for i, (a, b) in enumerate(zip(s.tolist(), w.tolist())):
        at = i
        # a mean that is not above the one before is pooled with it: means compare without a division
        while starts and sums[-1] * b >= a * weights[-1]:
            a, b, at = a + sums.pop(), b + weights.pop(), starts.pop()
        starts.append(at)
        sums.append(a)
        weights.append(b)
    return np.array(starts, np.int64)


def _pool_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    low, high, s, w = (rows.column(c).to_numpy() for c in ("low", "high", "s", "w"))
    at = pool(s, w)
    last = np.append(at[1:], len(s)) - 1
    yield pa.RecordBatch.from_arrays([pa.array(low[at]), pa.array(high[last]), pa.array(np.add.reduceat(s, at)), pa.array(np.add.reduceat(w, at))], names=["low", "high", "s", "w"])


def isotonic_blocks(df: DataFrame, score: str, y: str, weight: str | None = None, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """Stored (low, high, s, w): blocks of scores with one fitted value s / w each, strictly rising.

    Rows with a null score or target teach nothing; scores that are equal are one point.
    """
    v = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull()).select(F.col(score).cast("double").alias("x"), (F.col(y).cast("double") * v).alias("s"), v.alias("w")).filter("w > 0")
    points = rows.groupBy("x").agg(F.sum("s").alias("s"), F.sum("w").alias("w")).select(F.col("x").alias("low"), F.col("x").alias("high"), "s", "w")
    blocks, turn = cut(points), 0
    while True:
        n = blocks.count()
        slices = max(1, math.ceil(n / slice_blocks)) if n <= slice_blocks else math.ceil(n / slice_blocks) + 1 + turn % 2  # borders move from turn to turn
        sliced = blocks.repartitionByRange(slices, "low").sortWithinPartitions("low")
        pooled = cut(sliced.mapInArrow(_pool_slice, "low double, high double, s double, w double").withColumn("slice", F.spark_partition_id()))
        release(blocks)
        if slices == 1:
            return pooled.drop("slice")
        # only the blocks beside a border can still violate the order: two rows a slice
        ends = pooled.groupBy("slice").agg(F.min(F.struct("low", "s", "w")).alias("a"), F.max(F.struct("low", "s", "w")).alias("z"))
        before = F.lag("z").over(W.orderBy("slice"))
        if not ends.select("a", before.alias("b")).filter(F.col("b.s") * F.col("a.w") >= F.col("a.s") * F.col("b.w")).limit(1).count():
            return pooled.drop("slice")
        blocks, turn = pooled.drop("slice"), turn + 1
        blocks._scratch = pooled._scratch


def isotonic_apply(df: DataFrame, blocks: DataFrame, score: str, out: str) -> DataFrame:
    """Add the fitted value: level inside a block, on the straight line between two, level beyond the ends.

    One union and two running passes in the order of the score; no task holds all blocks.  A null score gives null.
    """
    knot = F.inline(F.array(F.struct(F.col("low").alias("x"), (F.col("s") / F.col("w")).alias("v")), F.struct(F.col("high").alias("x"), (F.col("s") / F.col("w")).alias("v"))))
    knots = blocks.select(knot).distinct().select("x", F.lit(0).alias("side"), F.struct("x", "v").alias("knot"))
    rows = df.select(F.col(score).cast("double").alias("x"), F.lit(1).alias("side"), F.struct(*df.columns).alias("row"))
    both = rows.unionByName(knots, allowMissingColumns=True)
    both = running(both, [], "x", "side", {"under": ("last", F.col("knot"))})
    both = running(both.withColumn("side", 1 - F.col("side")), [], "x", "side", {"over": ("last", F.col("knot"))}, descending=True)
    share = F.try_divide(F.col("x") - F.col("under.x"), F.col("over.x") - F.col("under.x"))
    value = F.when(F.col("under").isNull(), F.col("over.v")).when(F.col("over").isNull() | (F.col("under.x") == F.col("over.x")), F.col("under.v")).otherwise(
        F.col("under.v") + (F.col("over.v") - F.col("under.v")) * share)
    return both.filter(F.col("row").isNotNull()).select("row.*", F.when(F.col("x").isNotNull(), value).alias(out))
