"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import queries as q

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """One query for each operator."""
    return {k: v for k, v in vars(q).items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    """SQL twins of the queries that SQL can express."""
    return dict(q.ORACLES)
