"""Registry that pairs each Spark query with an independent ANSI SQL statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is left out where no SQL text can express the result."""
    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return add


def sql_of(name: str) -> str:
    """The SQL of a query that is already registered."""
    return _SQL[name]


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every query module and return both dictionaries."""
    from citeweave.plans import (  # noqa: F401
        q_anchoring, q_chunks, q_claims, q_entities, q_flows, q_gaps, q_graph, q_json, q_metrics, q_render, q_retrieval, q_scorecard,
        q_security, q_state, q_streams, q_upkeep, q_vectors,
    )
    return dict(_QUERIES), dict(_SQL)
