"""Time and space joins as sorts and equi joins: as-of, interval, adjacency, radius, nearest."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.operators.neighbors import knn
from larkspur.operators.windows import running

EARTH_KM = 6371.0


def asof(
    left: DataFrame, right: DataFrame, keys: Sequence[str], clock: str, right_clock: str, take: Sequence[str],
    direction: str = "backward", inclusive: bool = True, tolerance: int | None = None, prefix: str = "r_",
) -> DataFrame:
    """Attach the nearest right row before (``backward``) or after (``forward``) each left row.

    One union and one running ``last`` per key instead of a theta join: linear in rows, and a hot key is
    cut into ranges by the running operator.  ``clock`` columns are integers of one unit.  A null key or clock matches
    nothing; such left rows stay, with nulls.
    """
    keys = list(keys)
    back = direction == "backward"
    right_side = (0 if inclusive else 1) if back else (1 if inclusive else 0)
    hit = F.struct(F.col(right_clock).alias("at"), *[F.col(c).alias(c) for c in take])
    usable = F.col(right_clock).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    r = right.filter(usable).select(*keys, F.col(right_clock).cast("bigint").alias("_clock"), F.lit(right_side).alias("_side"), hit.alias("_hit"))
    rest = [c for c in left.columns]
    lft = left.select(*keys, F.col(clock).cast("bigint").alias("_clock"), F.lit(1 - right_side).alias("_side"), F.struct(*rest).alias("_row"))
    # of right rows at one instant the last by their values is taken, whichever way the search goes
    both = lft.unionByName(r, allowMissingColumns=True).withColumn("_tie", F.struct("_side", "_hit"))
    seen = running(both, keys, "_clock", "_tie", {"_m": ("last", F.when(F.col("_clock").isNotNull(), F.col("_hit")))}, descending=not back)
    out = seen.filter(F.col("_row").isNotNull())
    hit_col = F.when(F.col("_clock").isNotNull(), F.col("_m"))
    if tolerance is not None:
        hit_col = F.when(F.abs(F.col("_clock") - F.col("_m.at")) <= tolerance, hit_col)
    out = out.select("_row", hit_col.alias("_m"))
    return out.select(*[F.col(f"_row.{c}").alias(c) for c in rest], F.col("_m.at").alias(f"{prefix}clock"),
                      *[F.col(f"_m.{c}").alias(f"{prefix}{c}") for c in take])


def label_ahead(rows: DataFrame, marks: DataFrame, keys: Sequence[str], clock: str, mark_clock: str, horizon: int) -> DataFrame:
    """1 if a mark lies in (t, t + horizon], else 0."""
    out = asof(rows, marks, keys, clock, mark_clock, [], "forward", inclusive=False, tolerance=horizon)
    return out.withColumn("label", F.col("r_clock").isNotNull().cast("int")).drop("r_clock")


def exclude_after(rows: DataFrame, marks: DataFrame, keys: Sequence[str], clock: str, mark_clock: str, span: int) -> DataFrame:
    """Drop rows within ``span`` after a mark."""
    out = asof(rows, marks, keys, clock, mark_clock, [], "backward", inclusive=False, tolerance=span)
    return out.filter(F.col("r_clock").isNull()).drop("r_clock")


def first_flag_before(marks: DataFrame, flags: DataFrame, keys: Sequence[str], mark_clock: str, flag_clock: str, span: int) -> DataFrame:
    """Earliest flag in [mark - span, mark) per mark, as ``lead`` (mark minus flag), NULL if none."""
    probe = marks.withColumn("_from", F.col(mark_clock) - span)
    out = asof(probe, flags, keys, "_from", flag_clock, [], "forward", inclusive=True)
    return out.withColumn("lead", F.when(F.col("r_clock") < F.col(mark_clock), F.col(mark_clock) - F.col("r_clock"))).drop("_from", "r_clock")


def calibrate(
    sensor: DataFrame, reference: DataFrame, keys: Sequence[str], clock: str, value: str, ref_value: str, tolerance: int, min_pairs: int = 100
) -> DataFrame:
    """Slope and offset of the reference on the sensor per key, from readings paired in time.

    Keys with fewer than ``min_pairs`` pairs keep (1, 0).
    """
    pairs = asof(sensor, reference, keys, clock, clock, [ref_value], tolerance=tolerance)
    x, y = F.col(value), F.col(f"r_{ref_value}")
    fit = pairs.groupBy(*keys).agg(F.count(y).alias("n_pairs"), F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    enough = F.col("n_pairs") >= min_pairs
    return fit.select(*keys, "n_pairs", F.when(enough, F.col("_b")).otherwise(1.0).alias("slope"), F.when(enough, F.col("_a")).otherwise(0.0).alias("offset"))


def on_sphere(lat: str, lon: str) -> Column:
    """Point on the unit sphere; straight-line distance there is monotone in great-circle distance."""
    la, lo = F.radians(lat), F.radians(lon)
    return F.array(F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))


def arc_km(chord: Column | str) -> Column:
    c = F.col(chord) if isinstance(chord, str) else chord
    return F.lit(2 * EARTH_KM) * F.asin(F.least(c / 2, F.lit(1.0)))


def geo_nearest(queries: DataFrame, places: DataFrame, qid: str, bid: str, k: int, radius_km: float = math.inf, **options) -> DataFrame:
    """k nearest places (columns lat, lon) within a radius per query, with ``km``."""
    reach = math.inf if math.isinf(radius_km) else 2 * math.sin(radius_km / (2 * EARTH_KM))
    q = queries.withColumn("vec", on_sphere("lat", "lon"))
    p = places.withColumn("vec", on_sphere("lat", "lon"))
    return knn(q, p, k, qid, bid, radius=reach, **options).withColumn("km", arc_km("dist"))


def neighbour_lag(panel: DataFrame, edges: DataFrame, key: str, period: str, value: str, lag: int) -> DataFrame:
    """Mean of the neighbours' value ``lag`` periods earlier, by equi joins on (neighbour, period - lag)."""
    past = panel.select(F.col(key).alias("dst"), (F.col(period) + lag).alias(period), F.col(value).alias("_v"))
    around = edges.join(past, "dst").groupBy(F.col("src").alias(key), period).agg(F.avg("_v").alias("neighbour_mean"), F.count("_v").alias("n_neighbours"))
    return panel.join(around, [key, period], "left")
