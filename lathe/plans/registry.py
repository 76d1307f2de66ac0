"""Named queries and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered already")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return put
