"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its encoding: the token fits the
prefix's last bytes, and it is compatible with the token that ends the encoding of what stands before it. Two
tokens are compatible if encoding both together gives the two back. Storing that last token for each prefix
gives, by walking back, the encoding of every prefix; appending needs no work on what is there already, and an
edit needs new entries only until they agree with the old ones over the length of the longest token.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare

#: Words that each cache of a task holds, the longest one it takes, and pairs of tokens known to fit or not.
#: Between tasks an idle worker keeps the vocabulary only.
CACHE, CACHE_CHARS, CACHE_PAIRS = 500_000, 64, 300_000
#: Characters of text whose new words are encoded together, and marks that often end a word.
PRIME_CHARS, MARKS = 12 << 20, ".,;:!?%&*#$|"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}


class Vocabulary:
    """Tokens by rank, how each token comes about from two, and which neighbours are compatible."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Bytes that end a token -> the token that they are, or None.
        self.endings: dict[bytes, int | None] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.known: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None and left < rank and right < rank and self._fits(left, right):
                    self.merged[left, right] = rank
                    self.halves[rank] = (left, right)
                    break
            for i in range(len(token)):
                self.endings.setdefault(token[i:], ranks.get(token[i:]))

    def _fits(self, left: int, right: int) -> bool:
        """Undoes the later of the two tokens' last merges, again and again; the tokens stay apart only if at no
        point the two that meet would have been merged sooner than the merge undone last."""
        limit = float("inf")
        while True:
            joint = self.merged.get((left, right))
            if joint is not None and joint < limit:
                return False
            later_left = left in self.halves and (right not in self.halves or left > right)
            if later_left:
                limit, left = left, self.halves[left][1]
            elif right in self.halves:
                # Of equal ranks the left merge comes first, so one of this very rank would still win.
                limit, right = right + 1, self.halves[right][0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        found = self.known.get(left << 32 | right)
        if found is None:
            if len(self.known) > CACHE_PAIRS:
                self.known.clear()
            found = self.known[left << 32 | right] = self._fits(left, right)
        return found

    def last_tokens(self, data: bytes, last: list[int]) -> None:
        """Extends ``last``, the last tokens of the first prefixes of ``data``, to all of them."""
        endings, known = self.endings, self.known
        for end in range(len(last) + 1, len(data) + 1):
            start = end - 1
            while True:
                token = endings.get(data[start:end], -1)
                if token is not None:
                    if token < 0:
                        raise ValueError("the vocabulary lacks a byte")
                    if start == 0:
                        break
                    fits = known.get(last[start - 1] << 32 | token)
                    if self.compatible(last[start - 1], token) if fits is None else fits:
                        break
                start -= 1
            last.append(token)

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:  # also what the last of its prefixes would say
            return [whole]
        last: list[int] = []
        self.last_tokens(data, last)
        return self.walk(last, len(data))

    def walk(self, last: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at - 1])
            at -= len(self.bytes_of[out[-1]])
        return out[::-1]


class PrefixTable:
    """The unique last token of every prefix of ``data``; grows by appends and mends itself near edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.last_tokens(self.data, self.last)

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replaces data[start:stop]; returns how many entries had to be found anew.

        Entries behind the edit depend on no more than the longest token's length of bytes and entries before them,
        so they hold again once that many in a row have come out as they were."""
        shift, reach, size = len(new) - (stop - start), self.vocabulary.longest, len(self.data)
        self.data = self.data[:start] + new + self.data[stop:]
        # Only a stretch around the edit is looked at: one longest token before it, and as far behind as needed.
        base = max(0, start - reach)
        fresh, end, same = self.last[base:start], start, 0
        while end < len(self.data):
            end += 1
            self._next(fresh, base, end)
            old = end - 1 - shift
            same = same + 1 if end > start + len(new) and self.last[old] == fresh[-1] else 0
            if same >= reach:
                break
        self.last[start : min(end - shift, size) if end < len(self.data) else size] = fresh[start - base :]
        return end - start

    def _next(self, fresh: list[int], base: int, end: int) -> None:
        """Appends the entry of the first ``end`` bytes to ``fresh``, which holds those from ``base`` on."""
        v, at = self.vocabulary, end - 1
        while True:
            token = v.endings.get(self.data[at:end], -1)
            if token is not None:
                if token < 0:
                    raise ValueError("the vocabulary lacks a byte")
                if at == 0 or v.compatible(fresh[at - 1 - base] if at > base else self.last[at - 1], token):
                    fresh.append(token)
                    return
            at -= 1

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        return self.vocabulary.walk(self.last, len(self.last) if end is None else end)


class _Words(dict):
    """word -> its ids, packed."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        packed = self.encode(self.lead + word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[word] = packed
        return packed


class Encoder:
    """Whole texts to packed ids and back: each match of ``pattern`` is encoded by itself.

    Spaces that stand alone between other characters always begin a match, so the text is cut there and each
    stretch looked up; only texts with a space beside other white space go through the pattern as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        # regex counts U+001C to U+001F as white space; the Unicode property does not.
        space = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{space}").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))
        blanks = [c for c in map(chr, range(0x3001)) if regex.match(f"[{space}]", c)]
        self.beside = [x for c in blanks for x in dict.fromkeys((c + " ", " " + c))]
        self.parts = _Words(self._match, "")
        self.spaced = _Words(self._stretch, " ")
        self.first = _Words(self._stretch, "")
        self.bytes_of = [self.vocabulary.bytes_of.get(i, b"") for i in range(max(self.vocabulary.bytes_of) + 1)]
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)

    def _match(self, match: str) -> bytes:
        ids = self.vocabulary.encode(match.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _stretch(self, text: str) -> bytes:
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self._match(text)  # one match of letters
        return b"".join([self.spaced[m[1:]] if m[0] == " " and m[1:].isalpha() else self.parts[m] for m in self.pattern.findall(text)])

    def prime(self, texts: list[str | None]) -> None:
        """Encodes the new words of ``texts`` in sorted order: a word's table of prefixes starts from that of the
        word before, as far as both agree, so bytes that many words begin with are looked at once."""
        words: set[str] = set()
        for t in texts:
            words.update((t or "").split(" "))
        cores = {w.rstrip(MARKS) for w in words if w not in self.spaced} - self.spaced.keys()
        matches = sorted((" " + w).encode() for w in cores if len(w) <= CACHE_CHARS and w.isalpha())
        if len(self.spaced) + len(matches) > CACHE:
            self.spaced.clear()
        before, last, v = b"", [], self.vocabulary
        for data in matches:
            shared = 0
            for a, b in zip(before, data):
                if a != b:
                    break
                shared += 1
            del last[shared:]
            v.last_tokens(data, last)
            ids = v.walk(last, len(data))
            self.spaced[data[1:].decode()] = struct.pack(f"<{len(ids)}I", *ids)
            before = data

    def forget(self) -> None:
        """Empties the caches."""
        for cache in (self.parts, self.spaced, self.first, self.vocabulary.known):
            cache.clear()
        pa.default_memory_pool().release_unused()

    def encode(self, text: str | None) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if text[0] == " " or text[-1] == " " or any(x in text for x in self.beside):
            return self._stretch(text)
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_BUILT: dict[str, Encoder] = {}


def encoder_for(held, pattern: str) -> Encoder:
    """The worker's encoder for a broadcast (digest, ranks); built once in each worker."""
    digest, ranks = held.value
    key = digest + pattern
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Encoder(ranks, pattern)
    return _BUILT[key]


def primed(encoder: Encoder, column: pa.Array) -> Iterator[str | None]:
    """The texts of a column, the encoder's caches filled ahead."""
    group, size = [], 0
    for text in column:
        group.append(text.as_py())
        size += len(group[-1] or "")
        if size >= PRIME_CHARS:
            encoder.prime(group)
            yield from group
            group, size = [], 0
    encoder.prime(group)
    yield from group


@contextlib.contextmanager
def lent(held, pattern: str) -> Iterator[Encoder]:
    """The worker's encoder for as long as a task runs; its caches are emptied afterwards."""
    encoder = encoder_for(held, pattern)
    try:
        yield encoder
    finally:
        encoder.forget()


def held_ranks(spark: SparkSession, path: str):
    """The rank file, read by the driver and broadcast: a vocabulary's size does not depend on the corpus."""
    prepare(spark)
    ranks = load_ranks(path)
    return spark.sparkContext.broadcast((hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), ranks))


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (if ``keep_ids``), ids_sha256, decoded_sha256 for each row of ``docs`` (doc_id, text).

    The ids are those that merging by rank gives for each match of ``pattern``; they are then decoded and the
    bytes hashed. Null text is empty: no ids, the digests of nothing. Ids may be null or repeat; other
    columns are not read. Texts are handled one at a time, whole.
    """
    held = held_ranks(docs.sparkSession, ranks_path)
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent(held, pattern) as encoder:
            for batch in batches:
                counts, ids, shas, backs = [], [], [], []
                for text in primed(encoder, batch.column(1)):
                    packed = encoder.encode(text)
                    counts.append(len(packed) // 4)
                    shas.append(hashlib.sha256(packed).hexdigest())
                    backs.append(hashlib.sha256(encoder.decode(packed)).hexdigest())
                    if keep_ids:
                        ids.append(np.frombuffer(packed, "<i4"))
                out = [batch.column(0), pa.array(counts, pa.int64()), *([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), pa.array(shas, pa.string()), pa.array(backs, pa.string())]
                yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, T.StructType(fields))
