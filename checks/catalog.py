"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayframe.sources.adapters import Network

from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def oracles() -> dict[str, str]:
    """Runnable SQL per query; views are put in front once every group has named its own."""
    return {key: with_views(sql) for key, sql in ORACLES.items()}


def query(sql: str | None = None, name: str | None = None):
    """Register ``f(net)`` under its own name, with the SQL that must give the same rows."""

    def register(f: Callable[[Network], DataFrame]):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, folder: f(Network(spark, folder))
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register
