"""Registry of named queries: a Spark builder and (where SQL can express it) a
DuckDB oracle string over the same parquet tables.

Every query reads whole tables (or frames Spark derives from them); nothing
runs on literals alone.  Column names are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import q_scalar, q_vectors, q_dbscan, q_quotes, q_themes, q_reports  # noqa: F401
