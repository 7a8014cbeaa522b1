"""Registration of named queries with the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .domain import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(names: str | list[str], sql: str | None = None) -> Callable:
    """Registers a function of Tables, under each of several names if it has them. sql may use the domain's views."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        for name in [names] if isinstance(names, str) else names:
            QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql is not None:
                SQL[name] = SQL_VIEWS(sql)
        return f

    return register
