"""Sessions and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_spark(name: str = "millrace", **conf: str) -> SparkSession:
    """A session with adaptive execution, ANSI arithmetic and UTC; cluster settings come from the submitter."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


class SharedTables:
    """Named tables for all parts of a program: temporary views, cached on demand, guarded against overwriting."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def add(self, name: str, df: DataFrame, cache: bool = False, overwrite: bool = False) -> None:
        from ..errors import MutationError

        if not overwrite and self.spark.catalog.tableExists(name):
            raise MutationError(f"{name} is there already")
        df.createOrReplaceTempView(name)
        if cache:
            self.spark.catalog.cacheTable(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.table(name)
