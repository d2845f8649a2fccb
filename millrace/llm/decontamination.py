"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items, one scan per text.

Normalising maps bytes to bytes: A-Z to a-z, digits, letters and all bytes from 0x80 up to themselves, the rest to
a space; what stands between spaces is a word. Words of the benchmark have codes of two characters, all other words
share one, and the automaton runs over codes: a text is scanned once, word by word. First and second characters are
of different ranges, so no match begins within a word; a node has no more children than the square root of the words.

Not each window is a pattern, since neighbouring windows say nearly the same. Patterns are pieces of the items of
PIECE words that begin at every STEP-th word; a window of eight words holds at least one of them whole wherever it
begins. Where a piece occurs in a text, the words around it are held against those around it in the items, and each
window that agrees in full is an occurrence. Items of fewer than eight words are patterns of their own. Offsets go
back through the word's number to the bytes and characters of the original.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, packed_row, prepare, saved

WINDOW = 8
#: Words that stand between the beginnings of two pieces; a piece has WINDOW - STEP + 1 words.
STEP = 3
#: Benchmark text that one automaton holds: some 110 MB of a worker's memory. A larger benchmark is scanned for in several
#: blocks of this size, one after the other.
BLOCK_BYTES = 2 << 20
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Range of the codes' first characters, the code of words that no item has, and what stands between two items.
_FIRST, _OTHER, _NOTHING = 0x4000, "\0\0", "\0\1"
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def _numbers(codes: str) -> np.ndarray:
    """One number for each code of two characters."""
    return np.frombuffer(codes.encode("utf-16-le"), "<u4")


class Windows:
    """Automaton over the windows of (item_id, text) rows; repeated items and equal texts count as one text."""

    def __init__(self, items: Iterable[tuple[object, str | None]], window: int = WINDOW, step: int = STEP):
        self.window, self.piece = window, window - step + 1
        owners: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item, text in items:
            if words := tuple(normal_words(text)):
                owners[words].add(item)
        numbers: dict[bytes, int] = {}
        for words in owners:
            for w in words:
                numbers.setdefault(w, len(numbers))
        side = math.isqrt(len(numbers)) + 1
        letters = [chr(_FIRST + i // side) + chr(1 + i % side) for i in range(len(numbers))]
        self.code = dict(zip(numbers, letters)).get
        #: Items of each distinct text, and all long texts end to end, with room for a window between two.
        self.items = [sorted(x, key=str) for x in owners.values()]
        short: dict[str, int] = {}
        places: dict[str, list[int]] = defaultdict(list)
        line, starts, which = [_NOTHING * window], [], []
        size = window  # words of ``line``
        for k, words in enumerate(owners):
            codes = "".join(map(self.code, words))
            if len(words) < window:
                short[codes] = k
                continue
            starts.append(size)
            which.append(k)
            for i in range(0, len(words) - self.piece + 1, step):
                places[codes[2 * i : 2 * (i + self.piece)]].append(size + i)
            line += [codes, _NOTHING * window]
            size += len(words) + window
        self.line, self.starts, self.which = _numbers("".join(line)), np.array(starts, np.int64), np.array(which, np.int64)
        self.places = [np.array(p, np.int64) for p in places.values()]
        self.automaton = ahocorasick.Automaton()
        # A short item may also be a piece, so a pattern has a place in either or both.
        for k, codes in enumerate(places):
            self.automaton.add_word(codes, (len(codes) // 2, k, short.pop(codes, -1)))
        for codes, k in short.items():
            self.automaton.add_word(codes, (len(codes) // 2, -1, k))
        self.empty = not owners
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """Words in the text, runs (first, last + 1) of hit words in order, items with windows that occur."""
        words = normal_words(text)
        if self.empty or not words:
            return len(words), [], set()
        code = self.code
        line = "".join([code(w, _OTHER) for w in words])
        found = list(self.automaton.iter(line))
        if not found:
            return len(words), [], set()
        room = self.window - self.piece
        seen = _numbers(_OTHER * room + line + _OTHER * room)
        hits: list[tuple[int, int]] = []
        texts: set[int] = set()
        for end, (length, piece, short) in found:
            end //= 2
            first = end - length + 1
            if short >= 0:
                hits.append((first, first + length))
                texts.add(short)
            if piece >= 0:
                at = self.places[piece]
                # Of ``room`` words on both sides: do they agree, all the way to the piece?
                left = np.cumprod([self.line[at - i] == seen[room + first - i] for i in range(1, room + 1)], 0, dtype=np.int8).sum(0)
                right = np.cumprod([self.line[at + self.piece - 1 + i] == seen[room + end + i] for i in range(1, room + 1)], 0, dtype=np.int8).sum(0)
                whole = left + right >= room
                if whole.any():
                    texts.update(self.which[np.searchsorted(self.starts, at[whole], side="right") - 1].tolist())
                    hits += {(first - a, end + 1 + b) for a, b in zip(left[whole].tolist(), right[whole].tolist())}
        runs: list[list[int]] = []
        for a, b in sorted(hits):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        return len(words), [tuple(r) for r in runs], {x for k in texts for x in self.items[k]}


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as spans of characters (end exclusive) in the text as it was."""
    data = text.encode()
    at = [m.span() for m in _WORD.finditer(data)]
    before = np.cumsum(np.concatenate(([0], (np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))  # characters begun
    return [(int(before[at[a][0]]), int(before[at[b - 1][1]])) for a, b in runs]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ARROW = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": _SPANS}
_LONG = T.LongType()
_TYPES = T.StructType().add("n_words", _LONG).add("n_hit", _LONG).add("items", T.ArrayType(T.StringType())).add("spans", T.ArrayType(T.StructType().add("start", _LONG).add("end", _LONG)))


def _parts(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """The items with the block each is dealt to, and how many blocks there are; the sizes alone come to the driver."""
    sized = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = total // block_bytes + 1
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
    return (saved(dealt) if parts > 1 else dealt), parts


def _united(text: str, spans: list[dict]) -> tuple[list[dict], int]:
    """Overlapping spans of several automata joined, and the words inside."""
    runs: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if runs and s["start"] <= runs[-1]["end"]:
            runs[-1]["end"] = max(runs[-1]["end"], s["end"])
        else:
            runs.append(dict(s))
    return runs, sum(len(normal_words(text[s["start"] : s["end"]])) for s in runs)


_BUILT: dict[str, Windows] = {}


def _built(held, window: int) -> Windows:
    """The worker's automaton for a broadcast (digest, items); built once in each worker, the last one only."""
    digest, items = held.value
    key = f"{digest} {window}"
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Windows(items, window)
    return _BUILT[key]


def _scan(packed: DataFrame, items: list[tuple], window: int) -> DataFrame:
    """Scans for one more block of items: adds its finds to those that ``packed`` has."""
    digest = hashlib.sha256(repr(items).encode()).hexdigest()
    held = packed.sparkSession.sparkContext.broadcast((digest, items))  # about block_bytes of text
    again = "n_words" in packed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _built(held, window)
        for batch in batches:
            rows = []
            before = zip(batch.column("items"), batch.column("spans")) if again else None
            for text in batch.column("text"):
                text = text.as_py()
                n, runs, found = windows.scan(text)
                items_, hit = sorted(map(str, found)), sum(b - a for a, b in runs)
                spans = [{"start": a, "end": b} for a, b in original_spans(text, runs)] if runs else []
                if before:
                    had_items, had_spans = next(before)
                    items_ = sorted({*items_, *had_items.as_py()})
                    spans, hit = _united(text or "", [*spans, *had_spans.as_py()])
                rows.append((n, hit, items_, spans))
            added = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_ARROW.values())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), *added], ["row", "text", *_ARROW])

    return packed.mapInArrow(run, T.StructType([packed.schema["row"], packed.schema["text"], *_TYPES.fields]))


def contaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (the input row, all columns), text, n_words, n_hit, items (ids as strings, sorted), spans (characters
    of runs of hit words, end exclusive).

    One automaton scans each text once. A benchmark of more than ``block_bytes`` takes several: block after block
    comes to the driver, is scanned for, and what it finds is written before the next comes, so neither the driver
    nor a worker ever holds more than one. An item longer than a block is a block by itself. Null text has no words;
    an item without words has no window; repeated items count once; repeated rows are scanned each. Input columns
    may have any names: they stay inside ``row``.
    """
    prepare(docs.sparkSession)
    packed = docs.select(packed_row(docs), F.col("text").cast("string").alias("text"))
    dealt, parts = _parts(benchmark, block_bytes)
    last = None
    for part in range(parts):
        rows = (dealt.where(F.col("part") == part) if parts > 1 else dealt).select("item_id", "text").collect()
        packed = _scan(packed, sorted((tuple(r) for r in rows), key=str), window)
        if part + 1 < parts:
            packed, before = saved(packed), last
            if before is not None:
                discard(before)
            last = packed
    if parts > 1:
        discard(dealt)
    return packed


def contamination_report(docs: DataFrame, benchmark: DataFrame, least_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_items >= ``least_items``), items, spans, for
    each row, repeated ones too; nulls as in ``contaminate``. Without items nothing is contaminated."""
    seen = contaminate(docs.select("doc_id", "text"), benchmark)
    n_items = F.size("items").cast("long")
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return seen.select("row.doc_id", "n_words", "n_hit", n_items.alias("n_items"), digest.alias("items_sha256"), (n_items >= least_items).alias("contaminated"), "items", "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_items: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, that hold windows of fewer than ``least_items`` items. Null and empty texts
    hold none and stay; repeated rows share their fate; an empty table stays empty."""
    return contaminate(docs, benchmark).where(F.size("items") < least_items).select("row.*")
