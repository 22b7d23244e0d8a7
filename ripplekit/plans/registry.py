from __future__ import annotations

from collections.abc import Callable

from ..sources.views import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views=()):
    """Register a Spark plan ``fn(spark, sf_dir) -> DataFrame`` under ``name``;
    ``sql`` (optional) is the equivalent DuckDB query over the same tables."""
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn
    return deco
