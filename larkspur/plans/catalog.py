"""All registered queries."""

from __future__ import annotations

import importlib

from larkspur.plans.registry import QUERIES, SQL

_MODULES = ["columns", "missing", "aggregates", "calendars", "series", "texts", "joining", "scoring", "preparing", "monitoring", "vectors", "learning", "fitted", "flows"]


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"larkspur.plans.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(SQL)
