"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larkspur.llm.common import table


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Rounds of joins and partial aggregates: every node points at its smallest neighbour, edges move up to the pointed-at
    nodes and pointers jump one step, until each component is a star around its smallest node.  The rounds grow with
    the logarithm of the longest path; each is written to the shared folder.  Null ends and loops are left out.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, mark = table(e, "edges"), None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        ends = e.select(F.col("a").alias("node"), F.col("b").alias("near")).unionAll(e.select("b", "a")).groupBy("node").agg(F.min("near").alias("near"))
        up = table(ends.select("node", F.least("node", "near").alias("up")), "pointers")
        top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = up.join(top, "up").select(F.col("node").alias("a"), F.col("top").alias("b"))
        moved = e.join(up.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        moved = moved.select(F.greatest("ua", "ub").alias("a"), F.least("ua", "ub").alias("b"))
        e = table(jumped.unionAll(moved).filter("a <> b").distinct(), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select("b", "b").distinct())
