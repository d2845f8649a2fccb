"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rows import named as column
from ..storage import discard, saved

__all__ = ["ascii_lower", "column", "dealt", "discard", "packed_row", "prepare", "read", "saved", "sized_broadcast"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Rows that go to a Python worker at once, unless the session sets another number than Spark's own. Texts are long:
#: at Spark's 10,000 a batch of them, held on both sides, is much of an executor's memory.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Lets Python workers find this package in the folder where the driver has it, whatever their own path is, and
    has texts sent to them in smaller batches."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(scan: DataFrame) -> DataFrame:
    """A plain scan of a small table, dealt to all cores if it has fewer partitions than there are. Only for inputs
    of operators whose results do not depend on how rows are dealt."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def packed_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct named row, so that none can clash with an operator's own."""
    return F.struct(*map(column, docs.columns)).alias("row")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does just that to pure ASCII, and far faster than ``translate``."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def sized_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows stay within ``most``, else as it is: the join then
    shuffles, and adaptive execution splits its hot keys."""
    return F.broadcast(df) if rows <= most else df
