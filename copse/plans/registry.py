"""Queries of the plot operators: name to callable, name to oracle SQL.

Plan modules register with :func:`query`; ``MODULES`` lists them.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("points", "scores", "gps", "tiles", "canopy", "trees", "models")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a callable (spark, sf_dir) -> DataFrame under ``name``, with its oracle SQL if there is one."""

    def put(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    for m in MODULES:
        import_module(f"copse.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
