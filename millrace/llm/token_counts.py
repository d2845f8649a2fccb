"""Token counts by offset-mapped attribution: whole texts are encoded once, and the tokens' character spans
are joined to the spans of fields or sections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Encoder, held_ranks, lent, primed


def lines(text: str) -> list[int]:
    """First characters of the sections of a text: one section a line, its line feed included."""
    starts, at = [0], text.find("\n")
    while at >= 0:
        if at + 1 < len(text):
            starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def token_spans(encoder: Encoder, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token. A token that holds part of a character's bytes spans all of it."""
    data = np.frombuffer(text.encode(), np.uint8)
    stops = np.cumsum(encoder.lengths[np.frombuffer(encoder.encode(text), "<u4")])
    if not len(stops):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    char_of = np.cumsum((data & 0xC0) != 0x80) - 1
    starts = np.concatenate(([0], stops[:-1]))
    return char_of[starts], char_of[stops - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, sections: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and tokens that cross its end, by interval join of the two sorted lists.

    The rule: a token belongs to the section that holds its first character, wherever it ends. Counts over
    the sections therefore add up to the text's tokens; crossing ones are also reported.
    """
    owner = np.searchsorted(sections, starts, side="right") - 1
    ends_of = np.append(np.array(sections[1:], np.int64), length)
    crossing = ends > ends_of[owner]
    n = len(sections)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def section_tokens(docs: DataFrame, ranks_path: str, pattern: str, sections: Callable[[str], list[int]] = lines) -> DataFrame:
    """doc_id, n_tokens, n_chars, sections: array<struct<start, end, n_tokens, n_crossing>> for each row.

    ``sections`` maps a text to the increasing first characters of its sections, 0 first. Null and empty
    texts have one empty section without tokens. Ids may be null or repeat; other columns are not read.
    """
    held = held_ranks(docs.sparkSession, ranks_path)
    part = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "n_tokens", "n_crossing")])
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("sections", T.ArrayType(part))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent(held, pattern) as encoder:
            for batch in batches:
                n_tokens, n_chars, found = [], [], []
                for text in primed(encoder, batch.column(1)):
                    text = text or ""
                    starts, ends = token_spans(encoder, text)
                    cuts = sections(text)
                    inside, crossing = attribute(starts, ends, cuts, len(text))
                    n_tokens.append(len(starts))
                    n_chars.append(len(text))
                    found.append(np.array([cuts, [*cuts[1:], len(text)], inside, crossing], np.int64))
                offsets = pa.array(np.concatenate(([0], np.cumsum([f.shape[1] for f in found]))), pa.int32())
                every = np.concatenate(found, 1) if found else np.empty((4, 0), np.int64)
                parts = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(map(pa.array, every)), [f.name for f in part]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(n_chars, pa.int64()), parts], schema.names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def token_report(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, section_tokens (array, in order of the lines) for each row, repeated
    ones too. Null and empty texts have one section without tokens; a token that ends a line and begins the next
    counts for the first and as crossing."""
    seen = section_tokens(docs, ranks_path, pattern)
    crossing = F.aggregate("sections", F.lit(0).cast("long"), lambda a, s: a + s["n_crossing"])
    return seen.select("doc_id", "n_tokens", F.size("sections").cast("long").alias("n_sections"), crossing.alias("n_crossing"), F.transform("sections", lambda s: s["n_tokens"]).alias("section_tokens"))
