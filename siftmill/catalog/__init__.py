"""The registered queries and, where SQL can say it, their equivalent for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query under `key`, with its SQL equivalent if there is one."""

    def register(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from siftmill.catalog import (  # noqa: F401
        columns,
        jobs,
        models,
        sampling,
        scans,
        scores,
        sets,
        streams,
        turns,
        vectors,
    )
