"""Calendar columns and regular grids."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.functions.scalar import flag


def calendar_parts(ts: str) -> dict[str, Column]:
    """Monday is 0."""
    c = F.col(ts)
    return {
        "dow": F.weekday(c), "dom": F.dayofmonth(c), "iso_week": F.weekofyear(c), "month": F.month(c), "quarter": F.quarter(c),
        "doy": F.dayofyear(c), "is_weekend": flag(F.weekday(c) >= 5), "month_start": flag(F.dayofmonth(c) == 1),
        "month_end": flag(F.to_date(c) == F.last_day(c)),
    }


def cyclical(value: Column, period: float, name: str) -> dict[str, Column]:
    angle = F.lit(2 * pi) * value / F.lit(float(period))
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def densify(df: DataFrame, keys: Sequence[str], period: str, fills: dict, bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """Every (entity, period) cell between the first and last integer period, empty cells filled.

    The spine is made by exploding each entity's own range, so it is spread like the entities.
    """
    keys = list(keys)
    first, last = bounds or (df.agg(F.min(period)).scalar(), df.agg(F.max(period)).scalar())
    spine = df.select(*keys).distinct().withColumn(period, F.explode(F.sequence(first, last)))
    return spine.join(df, [*keys, period], "left").fillna(fills)
