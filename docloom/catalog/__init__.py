"""Every operator as a named query over the given tables, with its SQL check.

A query is ``(spark, directory) -> DataFrame``. Its SQL is written independently and
runs on the same tables; queries without SQL are checked by tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            CHECKS[function.__name__] = sql
        return function

    return register


def load() -> None:
    from docloom.catalog import models, retrieval, streams, tables, text  # noqa: F401
