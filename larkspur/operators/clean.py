"""Column cleaning: drops, fills, caps, bins, duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from larkspur.operators.prefix import exact_quantiles
from larkspur.operators.windows import group_values


def attach_one(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row as a scalar subquery (no join)."""
    packed = one_row.select(F.struct(*one_row.columns).alias("_one")).scalar()
    out = df.withColumn("_one", packed)
    return out.withColumns({c: F.col(f"_one.{c}") for c in one_row.columns}).drop("_one")


def weak_columns(df: DataFrame, max_null_share: float = 0.4) -> list[str]:
    """Columns that are mostly empty or constant, found in one aggregate pass (one row comes back)."""
    aggs = []
    for c in df.columns:
        aggs += [F.avg(F.col(c).isNull().cast("double")).alias(f"n_{c}"), (F.min(c) == F.max(c)).alias(f"k_{c}")]
    row = df.agg(*aggs).first()
    return [c for c in df.columns if (row[f"n_{c}"] or 0) > max_null_share or row[f"k_{c}"]]


def drop_columns(df: DataFrame, ids: Sequence[str] = (), max_null_share: float = 0.4) -> DataFrame:
    kept = df.drop(*ids)
    return kept.drop(*weak_columns(kept, max_null_share))


def missing_flags(df: DataFrame, cols: Sequence[str], suffix: str = "_missing") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": F.col(c).isNull().cast("int") for c in cols})


def fill_constant(df: DataFrame, values: dict) -> DataFrame:
    return df.fillna(values)


def impute(df: DataFrame, plan: dict[str, str], train: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Fill NULLs of each column with its ``median``/``mean``/``mode`` learned on the train rows.

    With ``by`` the group's value is used first and the overall one where the group has none.
    Mode ties go to the smallest value.
    """
    base = df.filter(train) if train is not None else df
    by = list(by)

    def learned(c: str, how: str, keys: list[str]) -> DataFrame:
        if how == "median":
            return exact_quantiles(base, c, {f"_f_{c}": 0.5}, keys)
        if how == "mean":
            return base.groupBy(*keys).agg(F.avg(c).alias(f"_f_{c}"))
        counts = base.filter(F.col(c).isNotNull()).groupBy(*keys, c).count()
        top = F.max_by(F.col(c), F.struct("count", -F.col(c) if _numeric(df, c) else _reverse(c)))
        return counts.groupBy(*keys).agg(top.alias(f"_f_{c}"))

    out = df
    for c, how in plan.items():
        overall = learned(c, how, []).scalar()
        fills = [F.col(c)]
        if by:
            mine = learned(c, how, by).withColumnsRenamed({k: f"_k_{k}" for k in by})
            cond = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in by])
            out = out.join(mine, cond, "left")
            fills.append(F.col(f"_f_{c}"))
        out = out.withColumn(c, F.coalesce(*fills, overall))
        if by:
            out = out.drop(f"_f_{c}", *[f"_k_{k}" for k in by])
    return out


def _numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def _reverse(c: str) -> Column:
    """A key that sorts strings backwards: each code point taken from the top of the range, the end last."""
    points = F.transform(F.split(F.col(c), ""), lambda ch: F.lit(1114112) - F.ascii(ch))
    return F.concat(points, F.array(F.lit(1114113)))


def cap_iqr(df: DataFrame, c: str, k: float = 3.0) -> DataFrame:
    """Cap at Q3 + k * IQR."""
    q = exact_quantiles(df, c, {"_q1": 0.25, "_q3": 0.75}).select((F.col("_q3") + k * (F.col("_q3") - F.col("_q1"))).alias("_cap"))
    return attach_one(df, q).withColumn(c, F.least(F.col(c), F.col("_cap"))).drop("_cap")


def cap_quantile(df: DataFrame, c: str, upper: float | None = None, lower: float | None = None, factor: float = 1.0) -> DataFrame:
    """Winsorise at the given quantiles (upper limit times ``factor``)."""
    probs = {n: p for n, p in (("_lo", lower), ("_hi", upper)) if p is not None}
    out = attach_one(df, exact_quantiles(df, c, probs))
    value = F.col(c)
    if upper is not None:
        value = F.least(value, F.col("_hi") * factor)
    if lower is not None:
        value = F.greatest(value, F.col("_lo"))
    return out.withColumn(c, value).drop(*probs)


def quantile_bins(df: DataFrame, c: str, k: int, out: str, base: DataFrame | None = None) -> DataFrame:
    """0-based quantile bin: edges at interpolated quantiles, right-closed, lowest included, equal edges merged."""
    probs = {f"_e{i}": i / k for i in range(k + 1)}
    edges = exact_quantiles(base if base is not None else df, c, probs)
    edges = edges.select(F.array_distinct(F.array(*probs)).alias("_edges"))
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    bin_no = F.size(F.filter(inner, lambda e: e < F.col(c)))
    inside = (F.col(c) >= F.element_at("_edges", 1)) & (F.col(c) <= F.element_at("_edges", -1))
    return attach_one(df, edges).withColumn(out, F.when(inside, bin_no)).drop("_edges")


def dedupe_subset(df: DataFrame, keys: Sequence[str], order: str, tie: str) -> DataFrame:
    """Keep the first row per key by (order, tie); an aggregate, so copies combine map-side."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(order, tie, *[F.col(c).alias(f"_v_{c}") for c in rest])).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first._v_{c}").alias(c) for c in rest]).select(*df.columns)


def top_n_other(df: DataFrame, c: str, n: int, other: str = "Other") -> DataFrame:
    """Keep the n most frequent values (ties by value), name the rest ``other``."""
    top = df.groupBy(c).count().orderBy(F.desc("count"), F.asc(c)).limit(n).agg(F.collect_list(c).alias("_top"))
    return df.withColumn(c, F.when(F.array_contains(top.scalar(), F.col(c)), F.col(c)).otherwise(other))


def group_filter(df: DataFrame, keys: Sequence[str], bad: Column) -> DataFrame:
    """Keep the groups in which no row is bad."""
    flagged = group_values(df.withColumn("_bad", bad.cast("int")), keys, {"_any": F.max("_bad")})
    return flagged.filter(F.coalesce(F.col("_any"), F.lit(0)) == 0).drop("_bad", "_any")


def corrected_skew(c: str) -> Column:
    """Bias-corrected skewness (sample form)."""
    n = F.count(c).cast("double")
    return F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long, values as doubles, NULLs kept."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])
    return df.select(*ids, F.inline(cells))


def polynomial(cols: Sequence[str], degree: int) -> dict[str, Column]:
    """All monomials of 1..degree without the constant; ``a*a*b`` is named ``a_a_b``."""
    terms: dict[str, Column] = {}

    def grow(start: int, picked: list[str]) -> None:
        if picked:
            terms["_".join(picked)] = reduce(lambda a, b: a * b, [F.col(p).cast("double") for p in picked])
        if len(picked) < degree:
            for i in range(start, len(cols)):
                grow(i, picked + [cols[i]])

    grow(0, [])
    return terms
