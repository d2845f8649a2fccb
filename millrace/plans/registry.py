"""Where queries register themselves with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self._path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self._path, name)


def query(sql: str | None = None):
    """Registers a function of Tables under its name; without ``sql`` only its rows can be checked."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, path: f(Tables(spark, path))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
