"""Hashes of values, rows and files."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AmbiguousArgumentError


def _text(digest: Column, base: int) -> Column:
    if base == 64:
        return F.base64(F.unhex(digest))
    if base != 32:
        raise AmbiguousArgumentError("base is 64 or 32")

    def extended_hex(batch: pd.Series) -> pd.Series:
        return batch.map(lambda h: None if h is None else base64.b32hexencode(bytes.fromhex(h)).decode().replace("=", "-").replace("----", "x032"))

    return F.pandas_udf(extended_hex, "string")(digest)


def hash_string(s: Column, base: int = 64) -> Column:
    """SHA-256 of the string in quotes, as its Python representation has it; text without quotes or escapes."""
    return _text(F.sha2(F.concat(F.lit("'"), s, F.lit("'")).cast("binary"), 256), base)


def hash_files(spark: SparkSession, path: str, base: int = 64) -> DataFrame:
    """(path, hash) of the bytes of each file."""
    return spark.read.format("binaryFile").load(path).select("path", _text(F.sha2("content", 256), base).alias("hash"))


def hash_rows(df: DataFrame) -> DataFrame:
    """One number for a table's content, whatever the order of its rows."""
    rows = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)").alias("h"))
    return rows.agg(F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("hash"))
