"""Named queries and the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(function):
        QUERIES[name or function.__name__] = function
        if sql:
            SQL[name or function.__name__] = sql
        return function

    return register
