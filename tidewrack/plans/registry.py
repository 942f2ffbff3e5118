"""Catalogue of the core queries: name, query and SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewrack.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "page_profile"


def query(name: str, sql: str | None = None):
    """Register a query function under ``name`` with its SQL counterpart."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


__all__ = ["FLAGSHIP", "ORACLE", "QUERIES", "query", "table"]
