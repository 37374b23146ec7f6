"""Registry of the runnable queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: QueryFn
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under ``name``; ``sql`` must return the same columns and rows."""
    def add(build: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, build, sql)
        return build
    return add


def load_all() -> dict[str, Query]:
    from riskframe.plans import (  # noqa: F401
        case_queries, file_queries, header_queries, history_queries, model_queries, source_queries, stream_queries, text_queries,
        url_queries,
    )
    return QUERIES
