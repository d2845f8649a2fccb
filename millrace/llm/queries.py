"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, exact_dedup, language_model, line_dedup, near_dedup, quality, secrets, sharding, token_counts
from .common import dealt, read

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(dealt(read(spark, sf_dir, "documents")), RANKS, PATTERN, keep_ids=False)


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(read(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(dealt(read(spark, sf_dir, "documents")))


def op4_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(dealt(read(spark, sf_dir, "documents"))).drop("set_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(dealt(read(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = decontamination.contamination_report(dealt(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))
    return seen.drop("items", "spans")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = quality.score_quality(dealt(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels"))
    return seen.select("row.doc_id", "evidence", "host_rate", "path_rate", "probability", "kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_report(dealt(read(spark, sf_dir, "documents")), RANKS, PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_bpe, op2_language_model, op3_exact_dedup, op4_reshard, op5_line_dedup, op6_near_dedup, op7_secret_scan, op8_decontamination, op9_quality, op10_token_counts)}

_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": f"""
WITH t AS (SELECT doc_id, {_NORMAL} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)""",
    "op5_line_dedup": line_dedup.SQL,
}
