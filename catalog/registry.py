"""Where queries and their SQL counterparts are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.sql import sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, counterpart: str | None = None, **more: str):
    """Register a query, with its SQL when there is one."""
    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if counterpart is not None:
            SQL[name] = sql(counterpart, **more)
        return build
    return add


def joined(names: str | Column, separator: str = ",") -> Column:
    """List as text, null for a missing or empty list."""
    column = F.col(names) if isinstance(names, str) else names
    return F.when(F.size(column) > 0, F.array_join(column, separator))
