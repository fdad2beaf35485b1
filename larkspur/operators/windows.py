"""Per-entity series features that survive an entity holding a third of all rows.

Every operator takes plain window expressions.  One count per entity says how the work is laid out: if no entity exceeds
``spark.larkspur.maxGroupRows`` the expressions run over ``partitionBy(entity)``; otherwise each series is cut into
ranges of its own order and each range carries the context it needs (a halo of preceding/following rows for bounded
frames, a carried aggregate for unbounded ones).  Both layouts give the same rows and values, those with a null key or
order included; only sums of doubles may differ in their last digits, as additions are grouped differently.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from larkspur.operators.prefix import numbered, ranged, same_keys
from larkspur.session import max_group_rows

Exprs = Callable[[WindowSpec], dict[str, Column]]


def has_hot_group(df: DataFrame, keys: Sequence[str]) -> bool:
    """Does any group of ``keys`` hold more rows than one task should?"""
    limit = max_group_rows(df.sparkSession)
    worst = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return (worst or 0) > limit


def at_least(frame: WindowSpec, value: str, need: int, result: Column) -> Column:
    """``result`` only where the frame holds ``need`` non-null values (minimum-period rule)."""
    return F.when(F.count(value).over(frame) >= need, result)


def over_rows(
    df: DataFrame, keys: Sequence[str], order: str, tie: str, exprs: Exprs, before: int = 0, after: int = 0
) -> DataFrame:
    """Add expressions over bounded row frames (``before`` preceding and ``after`` following rows)."""
    keys = list(keys)
    if not has_hot_group(df, keys):
        return df.withColumns(exprs(W.partitionBy(*keys).orderBy(order, tie)))
    chunk = max(max_group_rows(df.sparkSession) // 2, before + after, 1)
    ranked = numbered(df, order, tie, keys, "_rn")
    home = F.floor((F.col("_rn") - 1) / chunk)
    offset = (F.col("_rn") - 1) % chunk
    copies = F.array_compact(
        F.array(
            home,
            F.when(offset >= chunk - before, home + 1) if before else F.lit(None).cast("bigint"),
            F.when((offset < after) & (home > 0), home - 1) if after else F.lit(None).cast("bigint"),
        )
    )
    spread = ranked.withColumn("_home", home).withColumn("_chunk", F.explode(copies))
    series = W.partitionBy(*keys, "_chunk").orderBy("_rn")
    return (
        spread.withColumns(exprs(series))
        .filter(F.col("_chunk") == F.col("_home"))
        .drop("_rn", "_rn_total", "_home", "_chunk")
    )


def over_time(
    df: DataFrame, keys: Sequence[str], clock: str, span: int, exprs: Exprs, ahead: bool = False
) -> DataFrame:
    """Add expressions over a bounded range of ``clock`` (a numeric column, ``span`` in its unit).

    ``exprs`` receives a window ordered by ``clock`` and may use ``rangeBetween(-span, ..)`` (or
    ``rangeBetween(.., span)`` with ``ahead``).  Hot series are cut at multiples of the span.
    """
    keys = list(keys)
    if not has_hot_group(df, keys):
        return df.withColumns(exprs(W.partitionBy(*keys).orderBy(clock)))
    whole = df.schema[clock].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    # whole clocks are divided as whole numbers: a double would move those above 2**53 into another span
    home = F.expr(f"(`{clock}` - pmod(`{clock}`, {span})) div {span}") if whole else F.floor(F.col(clock) / span)
    copies = F.when(home.isNull(), F.array(home)).otherwise(F.array(home, home - 1) if ahead else F.array(home, home + 1))
    spread = df.withColumn("_home", home).withColumn("_chunk", F.explode(copies))
    series = W.partitionBy(*keys, "_chunk").orderBy(clock)
    return spread.withColumns(exprs(series)).filter(F.col("_chunk").eqNullSafe(F.col("_home"))).drop("_home", "_chunk")


_MERGE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
_OWN = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str,
    items: dict[str, tuple[str, Column]],
    include_current: bool = True,
    descending: bool = False,
) -> DataFrame:
    """Running ``sum/count/max/min/last`` from the start of each series.

    ``last`` keeps the newest non-null value (forward fill).  ``items`` maps the output name to
    (kind, expression).  A long series is cut into ranges; each is aggregated once and what all earlier
    ranges carry is merged in.  Rows with a null order come first (last where ``descending``), as in a window.
    """
    keys = list(keys)
    end = 0 if include_current else -1
    args = {f"_x_{n}": e for n, (_, e) in items.items()}
    base = df.withColumns(args)

    def way(col: str) -> Column:
        return F.col(col).desc() if descending else F.col(col).asc()

    def own(name: str, kind: str, frame: WindowSpec) -> Column:
        if kind == "last":
            return F.last(f"_x_{name}", ignorenulls=True).over(frame)
        return _OWN[kind](f"_x_{name}").over(frame)

    if not has_hot_group(df, keys):
        frame = W.partitionBy(*keys).orderBy(way(order), way(tie)).rowsBetween(W.unboundedPreceding, end)
        return base.withColumns({n: own(n, k, frame) for n, (k, _) in items.items()}).drop(*args)

    stored = ranged(base, keys, [order, tie])
    newest = F.struct(F.col(order), F.col(tie))
    pick = F.min_by if descending else F.max_by
    aggs = [
        (pick(F.col(f"_x_{n}"), F.when(F.col(f"_x_{n}").isNotNull(), newest)) if k == "last" else _OWN[k](f"_x_{n}")).alias(f"_a_{n}")
        for n, (k, _) in items.items()
    ]
    parts = stored.groupBy(*keys, "_slice").agg(*aggs)
    earlier = W.partitionBy(*keys).orderBy(way("_slice")).rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_o_slice"),
        *[
            (F.last(f"_a_{n}", ignorenulls=True) if k == "last" else _MERGE[k](f"_a_{n}")).over(earlier).alias(f"_c_{n}")
            for n, (k, _) in items.items()
        ],
    )
    frame = W.partitionBy(*keys, "_slice").orderBy(way(order), way(tie)).rowsBetween(W.unboundedPreceding, end)

    def merged(name: str, kind: str) -> Column:
        mine, past = own(name, kind, frame), F.col(f"_c_{name}")
        if kind == "last":
            return F.coalesce(mine, past)
        if kind in ("sum", "count"):
            return F.when(past.isNull(), mine).otherwise(past + F.coalesce(mine, F.lit(0)))
        return (F.greatest if kind == "max" else F.least)(mine, past)

    return (
        stored.join(carried, (F.col("_slice") == F.col("_o_slice")) & same_keys(keys))
        .withColumns({n: merged(n, k) for n, (k, _) in items.items()})
        .drop("_slice", "_o_slice", *args, *[f"_k_{k}" for k in keys], *[f"_c_{n}" for n in items])
    )


def range_sums(
    df: DataFrame, row_key: str, keys: Sequence[str], clock: str, items: dict[str, tuple[int, Column]]
) -> DataFrame:
    """Sums over the rows of the last ``span`` clock units before each row (the row's own instant excluded).

    ``items`` maps a name to (span, expression); 0 where no row is in range.  One path at every size: rows
    are first summed per instant, time is cut into chunks one span long, and a range is the end of the chunk
    before plus the beginning of the row's own.  Both are running sums inside a chunk, so nothing outside the
    range enters a sum and nothing is subtracted.  The sums depend on the series and the instant alone and
    are joined back by these, null-safe: ``row_key`` is not read and may be null or repeated.  Rows with a
    null clock form one instant of their own, as in a plain window.
    """
    keys = list(keys)
    kinds = dict(df.agg(*[F.sum(e).alias(n) for n, (_, e) in items.items()]).dtypes)
    series = [f"_k{i}" for i in range(len(keys))]
    instants = df.groupBy(*[F.col(k).alias(c) for k, c in zip(keys, series)], F.col(clock).alias("_t")).agg(
        *[F.sum(e).alias(f"_x_{n}") for n, (_, e) in items.items()])
    parts = [instants.filter("_t is null").select(*series, "_t", *[F.col(f"_x_{n}").alias(n) for n in items])]
    for span in sorted({span for span, _ in items.values()}):
        mine = [n for n, (s, _) in items.items() if s == span]
        sums = {n: ("sum", F.col(f"_x_{n}")) for n in mine}
        facts = instants.filter("_t is not null").select(*series, "_t", F.col("_t").alias("_at"), F.lit(1).alias("_side"), *[f"_x_{n}" for n in mine])
        # read from the latest backwards: at one instant facts (1) come before the probe (0) that asks for them
        probes = facts.select(*series, "_t", (F.col("_at") - span).alias("_at"), F.lit(0).alias("_side"))
        both = facts.unionByName(probes, allowMissingColumns=True)
        chunk = F.col("_at") - F.pmod(F.col("_at"), F.lit(span))
        begin = running(facts.withColumn("_chunk", chunk), [*series, "_chunk"], "_at", "_side", sums, include_current=False)
        end = running(both.withColumn("_chunk", chunk), [*series, "_chunk"], "_at", "_side", sums, descending=True).filter("_side = 0")
        parts += [p.select(*series, "_t", *mine) for p in (begin, end)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    whole = whole.groupBy(*series, "_t").agg(*[F.coalesce(F.sum(n).cast(kinds[n]), F.lit(0)).alias(n) for n in items])
    same = F.col(clock).eqNullSafe(F.col("_t"))
    for k, c in zip(keys, series):
        same = same & F.col(k).eqNullSafe(F.col(c))
    return df.drop(*items).join(whole, same, "left").drop(*series, "_t")


def group_values(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Attach per-group aggregates to every row: a partial aggregate joined back.

    A ``partitionBy`` window would buffer a whole hot group in one task; the aggregate combines
    map-side and its small result is joined (broadcast or skew-split by AQE).
    """
    keys = list(keys)
    if not keys:
        made = df.agg(F.struct(*[e.alias(n) for n, e in aggs.items()]).alias("_g"))
        return df.withColumn("_g", made.scalar()).withColumns({n: F.col(f"_g.{n}") for n in aggs}).drop("_g")
    made = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(*[e.alias(n) for n, e in aggs.items()])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = c if cond is None else cond & c
    return df.join(made, cond, "left").drop(*[f"_k_{k}" for k in keys])
