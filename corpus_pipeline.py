"""A corpus through five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, decontamination, exact_dedup, near_dedup, quality
from millrace.llm.common import read, saved
from millrace.llm.queries import PATTERN, RANKS


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are judged by their site; repeated rows
    share their fate; a probability on the threshold stays; no documents give none."""
    return quality.drop_low_quality(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the largest id. Null texts equal empty ones; of
    rows that repeat id and text one stays; null ids stay only where no equal text has an id; none give none."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id. Null and empty texts are
    near to nothing and stay; rows that repeat id and text share their fate; no documents give none."""
    return near_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go; one copied item is enough. Null and empty texts hold
    none and stay; repeated rows share their fate; without items, or documents, nothing goes."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"), least_items=1)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left, repeated rows each; null text has no ids."""
    return bpe.encode_texts(docs, RANKS, PATTERN, keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: A trained classifier and byte-pair encoding have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
