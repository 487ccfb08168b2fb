"""Registered queries over the driver tables, with the DuckDB SQL each is held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query under a name; sql is what DuckDB runs over the same tables."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    importlib.import_module("sigtrellis.plans.queries")
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    importlib.import_module("sigtrellis.plans.queries")
    return dict(_ORACLE)
