"""The registry of queries: name -> (function of (spark, sf_dir), SQL with the same rows or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def add(name: str, f: Query, sql: str | None) -> None:
    if name in QUERIES:
        raise ValueError(f"query registered twice: {name}")
    QUERIES[name] = (f, sql)


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        add(name, f, sql)
        return f

    return put
