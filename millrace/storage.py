"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import MissingArgumentError


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines of the cluster share. In local mode, where one machine is all there is, an own one
    is set if none is; elsewhere that is an error, since executors would write to disks that others cannot see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise MissingArgumentError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, and no lost executor
    can make a later step see other values than an earlier one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._saved_path = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes what ``saved`` wrote for ``df``, once no plan reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
