"""Registered queries, each with the SQL that checks it: `query` collects both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name. sql: CTEs over the fixture views and a SELECT."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {fixtures.SQL}{sql}" if sql.lstrip().startswith(",") else f"WITH RECURSIVE {fixtures.SQL} {sql}"
        return f

    return add
