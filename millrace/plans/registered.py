"""The registry itself, and helpers of the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL if it has any."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLE_SQL[key] = sql
        return fn

    return add


def shown(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    """Keys (timestamps as epoch seconds, days as text) and values, doubles rounded."""
    kinds = dict(df.dtypes)
    out = []
    for c in keys + values:
        if kinds[c].startswith("timestamp"):
            out.append(F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000).cast("long").alias(c))
        elif kinds[c] == "date":
            out.append(F.col(c).cast("string").alias(c))
        elif kinds[c] in ("double", "float"):
            out.append(F.round(F.col(c).cast("double"), digits).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
