"""Every registered query and, where SQL can express it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import composed, data, flights, learning, market, registered, trading

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = registered.QUERIES
ORACLE_SQL: dict[str, str] = registered.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "composed", "data", "flights", "learning", "market", "trading"]
