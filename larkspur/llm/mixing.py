"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.llm.common import WORD, ordered, table, unit

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, take the weights in turn.  ``share`` of all sizes is dealt out by weight;
    a source stops at ``most`` times its own size and its excess is dealt again among the others until none is above.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    per = ordered(per, [F.col("source").asc_nulls_last()], label="sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    per = table(per.select("source", "source_size", weight.alias("weight")), "weights")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("source_size") * F.lit(most)
        row = per.agg(F.sum(F.when(full, F.col("source_size"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weight"),
                      F.count(F.when(full, 1)).alias("n")).first()
        if row.weight is None:  # all sources are full, or there are none
            break
        now = (share * total - most * (row.full or 0)) / row.weight
        if level == now:
            break
        level = now
    # a level only rises, so a source that was full stays full
    target = F.least(F.col("weight") * F.lit(float("inf") if level is None else level), F.col("source_size") * F.lit(most))
    return per.select("source", "source_size", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def mix_plan(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows (doc_id, source, size, ..) with ``source_size``, ``target`` and ``copies``.

    Every document of a source expects target / source_size copies.  Their prefix sum runs over the source in the
    order of size, then doc_id, starting from one offset drawn from the source's name; a document is emitted once per
    integer boundary it crosses.  In that order neighbours weigh alike, so the words taken miss the target by less
    than the longest document's.  Equal input gives equal output.  ``sizes`` must be a stored table.
    """
    targets = source_targets(sizes, weights, share, most)
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last(), *[c for c in ("row",) if c in sizes.columns]]
    ranked = ordered(sizes, order, label="ranks")
    starts = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    starts = ordered(starts, [F.col("source").asc_nulls_last()], "rows", label="starts")
    per = table(targets.alias("t").join(starts.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")))
                .select(F.col("t.source").alias("_source"), "source_size", "target", F.col("before").alias("_start")), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("before") - F.col("_start")
    offset = unit(F.coalesce(F.col("source"), F.lit("")))
    crossed = F.floor(rate * (rank + 1) + offset) - F.floor(rate * rank + offset)
    return ranked.join(per, F.col("source").eqNullSafe(F.col("_source"))).select(*sizes.columns, "source_size", "target", crossed.cast("long").alias("copies"))


def document_sizes(docs: DataFrame) -> DataFrame:
    return table(docs.select("doc_id", "source", word_count().alias("size")), "sizes")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as :func:`mix_plan` says, all columns kept, whatever their names.

    Null text has size 0; a null source is a source of its own, the last one.  Ties in size go by doc_id, then by a
    hash of the row; rows alike in all columns are one row with the copies of all.  An empty table gives an empty mix.
    Rows are told apart by doc_id and that hash (64 bits).  Texts are shuffled once, and equal rows meet before that.
    """
    # a null moves no hash: which columns are null is hashed as well
    row = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])
    sizes = table(docs.select("doc_id", "source", word_count().alias("size"), row.alias("row")), "sizes")
    plan = mix_plan(sizes, weights, share, most).groupBy("doc_id", "row").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    whole = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), row.alias("row"), F.struct(*docs.columns).alias("doc"))
    once = whole.groupBy("id", "row").agg(F.first("doc").alias("doc"))
    plan = plan.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "row", "copies")
    out = once.join(plan.hint("merge"), ["id", "row"])
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document: size, its source's size and target, and the words the mix takes of it."""
    plan = mix_plan(document_sizes(docs))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, (ARRAY[5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM sized GROUP BY source),
steps AS (
  SELECT *, coalesce(sum(source_size) OVER earlier, 0)::DOUBLE AS full_size, sum(weight) OVER later AS rest, (sum(source_size) OVER ())::DOUBLE AS total
  FROM per
  WINDOW earlier AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         later AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (
  SELECT max((1.5::DOUBLE * total - 2.0::DOUBLE * full_size) / rest) AS height FROM steps
  WHERE weight * ((1.5::DOUBLE * total - 2.0::DOUBLE * full_size) / rest) < 2.0::DOUBLE * source_size),
targets AS (
  SELECT source, source_size, CASE WHEN source_size > 0 THEN least(weight * coalesce(height, 'inf'::DOUBLE), 2.0::DOUBLE * source_size) ELSE 0.0::DOUBLE END AS target
  FROM per, level),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST) AS r FROM sized),
rated AS (
  SELECT doc_id, size, source_size, target, r, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5(coalesce(k.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM ranked k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate * r + shift) - floor(rate * (r - 1) + shift))::BIGINT * size)::BIGINT AS taken FROM rated
"""
