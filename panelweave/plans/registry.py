"""Named queries and, where SQL can express them, the equivalent statement over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is defined twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load_all() -> None:
    from panelweave.plans import (  # noqa: F401
        queries_features,
        queries_fill,
        queries_groups,
        queries_link,
        queries_models,
        queries_ordered,
        queries_quality,
        queries_scalars,
        queries_windows,
    )
