"""Named queries over the data tables and their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under `name`, with the SQL that gives the same rows."""

    def add(query: Query) -> Query:
        _QUERIES[name] = query
        if sql:
            _ORACLE[name] = sql
        return query

    return add


def queries() -> dict[str, Query]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLE


def _load() -> None:
    """Import the modules that register queries."""
    from clueforge.plans import clue_queries, delivery_queries, fine_queries, function_queries, graph_queries, matching_queries, mention_queries, policy_queries, record_queries, relational_queries, source_queries, stream_queries  # noqa: F401


_load()
