"""Registry of queries: (spark, sf_dir) -> DataFrame, each with an optional DuckDB twin.

Every query reads the driver's tables (through ``sources.fixtures``) and runs
over whole tables. Nested outputs (maps, arrays of structs) are flattened to
rows so the oracle can compare them cell by cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco
