"""Registry of the catalogue queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that DuckDB can run for it."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__
        _QUERIES[key] = fn
        if oracle is not None:
            _ORACLES[key] = oracle
        return fn

    return add


def queries() -> dict[str, Query]:
    """All catalogue queries by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL twins by query name."""
    return dict(_ORACLES)
