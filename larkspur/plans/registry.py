"""Registry that pairs each Spark query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.functions.scalar import MIX_PRIME, POISSON1, ROUND_SHIFT
from larkspur.plans.views import with_views
from larkspur.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t)`` under ``name``; ``sql`` is its twin over the same tables."""

    def keep(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return keep


def r6(expr: str, digits: int = 6) -> str:
    """Twin of :func:`larkspur.functions.scalar.rnd`."""
    scale = float(10**digits)
    return f"(round(CAST({expr} AS DOUBLE) * {scale}::DOUBLE + {ROUND_SHIFT}::DOUBLE) / {scale}::DOUBLE + 0.0)"


def mix(key: str, seed: int | str = 0) -> str:
    """Twin of :func:`larkspur.functions.scalar.mix_hash`."""
    m = f"{MIX_PRIME}::BIGINT"
    low, high = f"(({key})::BIGINT & {m})", f"((({key})::BIGINT >> 31) & {m})"
    a = f"(({low} * 48271 + {high} * 69621 + ({seed})::BIGINT * 16807 + 1) % {m})"
    c = f"((({a} * {a} + 31 * {a} + {high} * 127773) % {m} * 69621 + {a} * (({seed})::BIGINT + 7)) % {m})"
    return f"((({c} * {c} + 8191 * {c} + {a}) % {m}) / {float(MIX_PRIME)}::DOUBLE)"


def poisson(u: str) -> str:
    """Twin of :func:`larkspur.functions.scalar.poisson1`."""
    return "(" + " + ".join(f"CAST({u} >= {p}::DOUBLE AS INT)" for p in POISSON1) + ")"
