"""LM scoring: unigram counts of the whole corpus and a gated recurrent language model in numpy.

Every word belongs to a unit. A word that holds at least ``SHARE`` of the training tokens is a unit of its own; all
other words share one of ``ENDINGS`` units, chosen by their last three bytes. The units, commonest first, stand in
classes of ``CLASS``. The state predicts a unit's class, then the unit within the class, so each word's probability
follows the state, rare and unknown ones included; within a unit of several words they follow their corpus counts,
smoothed by half a count, with half a count for all unknown words together. Scores are therefore log-probabilities
of one proper distribution. The state runs on through a text from window to window, so a text's score is the
log-likelihood of all of it. Gradients stop at a window's start (truncated backpropagation).

Training is data-parallel: every training text is learnt from once. Texts are dealt to groups by their hash, and the
groups to rounds. In each round all groups start from the same parameters, learn from their own texts in the order of
their hashes, and the results are averaged by tokens, in a tree. Nothing of this depends on how the input lies in
files or on the number of cores.

Texts are tokenised once, into a table of blocks: a block holds the distinct words of some 16 MB of text, under
64-bit hashes, and its texts as positions in that list. Counts are sums over the blocks' words; they grow with
the corpus, so they are never broadcast, and come back to the blocks by a join on the distinct words only.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, saved

#: Least share of the training tokens of a word with a unit of its own: 16,384 words at most can have it.
SHARE = 1 / 16384
#: Units for all other words, units to a class, state units, window, and lanes that run side by side.
ENDINGS, CLASS, UNITS, WINDOW, LANES = 4096, 64, 24, 32, 128
RATE, SHARES = 0.01, (0.15, 0.45, 1.0)  # step size; cumulative shares of the groups in each round
BLOCK_BYTES, GROUP_TOKENS, FAN_IN = 16 << 20, 2_500_000, 16
END = b""


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def word_hash(word: bytes) -> int:
    value = xxhash.xxh64_intdigest(word, 5)
    return value - (1 << 64) if value >> 63 else value


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


class GatedModel:
    """Parameters by name in float32: unit vectors e, input and recurrent weights w, u and biases b of the update
    gate, the reset gate and the candidate; weights of classes (wc) and of units (ww), the bias last. Units without
    a word fill up the last class; their bias gives them no share."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @classmethod
    def initial(cls, counts: list[float], units: int = UNITS, seed: int = 11) -> GatedModel:
        """Biases give the distribution of ``counts``, the units' in falling order."""
        rng, mass, n = np.random.default_rng(seed), np.array(counts, float) + 0.5, units
        classes = np.add.reduceat(mass, np.arange(0, len(mass), CLASS))
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        p = {"e": draw(0.5, len(mass), n), "w": draw(n**-0.5, n, 3 * n), "u": draw(0.5 * n**-0.5, n, 3 * n), "b": np.zeros(3 * n, np.float32)}
        p["b"][:n] = 1  # at first the state changes slowly
        p |= {"wc": np.zeros((len(classes), n + 1), np.float32), "ww": np.zeros((len(classes) * CLASS, n + 1), np.float32)}
        p["wc"][:, n], p["ww"][:, n] = np.log(classes / classes.sum()), -60
        p["ww"][: len(mass), n] = np.log(mass / mass.max())
        return cls(p)

    def copy(self) -> GatedModel:
        return GatedModel({k: v.copy() for k, v in self.p.items()})

    def run(self, x: np.ndarray, first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """States before each token and after the last one, [step, lane, unit]; and what backpropagation needs."""
        p, (steps, lanes), n = self.p, x.shape, h.shape[1]
        # Logistic functions are taken as hyperbolic tangents of half the argument.
        half = np.ones(3 * n, np.float32)
        half[: 2 * n] = 0.5
        inputs, u = p["e"][x.ravel()], p["u"] * half
        ax = (inputs @ (p["w"] * half) + p["b"] * half).reshape(steps, lanes, 3 * n)
        states, gates, rest, new = (np.empty((steps + k, lanes, m), np.float32) for k, m in ((1, n), (0, 2 * n), (0, n), (0, n)))
        states[0], hu, begins = h, np.empty((lanes, 3 * n), np.float32), first.any(1)
        for t in range(steps):
            if begins[t]:
                states[t][first[t]] = 0
            h, zr, c, after = states[t], gates[t], new[t], states[t + 1]
            np.matmul(h, u, out=hu)
            np.add(ax[t, :, : 2 * n], hu[:, : 2 * n], out=zr)
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            rest[t] = hu[:, 2 * n :]
            np.multiply(zr[:, n:], rest[t], out=c)
            c += ax[t, :, 2 * n :]
            np.tanh(c, out=c)
            np.subtract(h, c, out=after)
            after *= zr[:, :n]
            after += c
        return states, (inputs, gates, rest, new)

    def outputs(self, h: np.ndarray, y: np.ndarray, gradients: bool) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray | None]:
        """ln P of each target unit given its state; with the gradients of its sum, also by the states."""
        wc, ww, n = self.p["wc"], self.p["ww"], h.shape[1]
        # By class, so that the units of a class are one product; a last 1 takes the bias.
        order = np.argsort((y // CLASS).astype(np.uint16), kind="stable")
        y = y[order]
        c, at = y // CLASS, y % CLASS
        ordered = np.ones((len(y), n + 1), h.dtype)
        ordered[:, :n] = h[order]
        cuts = np.searchsorted(c, np.arange(len(wc) + 1))
        parts = [(slice(cuts[k], cuts[k + 1]), slice(k * CLASS, (k + 1) * CLASS)) for k in np.flatnonzero(np.diff(cuts))]
        said, dh = np.empty(len(y), h.dtype), np.empty_like(ordered) if gradients else None
        grad = {"wc": np.zeros_like(wc), "ww": np.zeros_like(ww)} if gradients else {}
        wct, every = np.ascontiguousarray(wc.T), np.arange(4096)

        def softmax(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
            """ln P of the targets; turns ``logits`` into gradients. Biases start as logarithms of shares and states
            lie within 1, so exponentials need no shift, only a bound."""
            np.minimum(logits, 60, out=logits)
            each = every[: len(logits)]
            told = logits[each, target]
            np.exp(logits, out=logits)
            total = logits @ np.ones(logits.shape[1], logits.dtype)
            if gradients:
                logits *= (-1 / total)[:, None]
                logits[each, target] += 1
            return told - np.log(total)

        inside = np.empty((len(y), CLASS), h.dtype)
        for rows, units in parts:
            np.matmul(ordered[rows], ww[units].T, out=inside[rows])
        for a in range(0, len(y), len(every)):  # slices that stay in the processor's cache
            own = slice(a, a + len(every))
            e = ordered[own] @ wct
            said[own] = softmax(e, c[own])
            said[own] += softmax(inside[own], at[own])
            if gradients:
                np.matmul(e, wc, out=dh[own])
                grad["wc"] += e.T @ ordered[own]
        logp = np.empty_like(said)
        logp[order] = said
        if not gradients:
            return logp, grad, None
        for rows, units in parts:
            dh[rows] += inside[rows] @ ww[units]
            grad["ww"][units] = inside[rows].T @ ordered[rows]
        by_state = np.empty_like(h)
        by_state[order] = dh[:, :n]
        return logp, grad, by_state

    def gradients(self, x: np.ndarray, first: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the window's log-likelihood; and the state after it."""
        p, (steps, lanes), n = self.p, x.shape, h.shape[1]
        states, (inputs, gates, rest, c) = self.run(x, first, h)
        y, before = x.ravel(), states[:-1]
        _, grad, dstates = self.outputs(before.reshape(-1, n), y, True)
        dstates = dstates.reshape(before.shape)
        # All factors that do not depend on what comes back from later steps, for the whole window at once.
        z, r = gates[..., :n], gates[..., n:]
        keep = 1 - z
        by_z, by_c = (before - c) * z * keep, keep * (1 - c * c)
        by_r = rest * r * (1 - r)
        da, through = np.empty((steps, lanes, 3 * n), np.float32), np.empty((steps, lanes, 3 * n), np.float32)
        dh, ut, begins = np.zeros((lanes, n), np.float32), np.ascontiguousarray(p["u"].T), first.any(1)
        for t in range(steps - 1, -1, -1):
            d, q = da[t], through[t]
            dc = d[:, 2 * n :]
            np.multiply(dh, by_c[t], out=dc)
            np.multiply(dh, by_z[t], out=d[:, :n])
            np.multiply(dc, by_r[t], out=d[:, n : 2 * n])
            q[:, : 2 * n] = d[:, : 2 * n]
            np.multiply(dc, r[t], out=q[:, 2 * n :])
            dh *= z[t]
            dh += q @ ut
            dh += dstates[t]
            if begins[t]:
                dh[first[t]] = 0
        flat = da.reshape(-1, 3 * n)
        grad["u"], grad["w"] = before.reshape(-1, n).T @ through.reshape(-1, 3 * n), inputs.T @ flat
        grad["b"] = np.ones(len(flat), np.float32) @ flat
        dinputs = flat @ np.ascontiguousarray(p["w"].T)
        order = np.argsort(y.astype(np.uint16), kind="stable")
        at = np.flatnonzero(np.diff(y[order], prepend=-1))
        grad["e"] = np.zeros_like(p["e"])
        grad["e"][y[order][at]] = np.add.reduceat(dinputs[order], at)
        return grad, states[-1]


@dataclass
class Lanes:
    """Texts laid end to end in lanes, longest lane first: arrays [step, lane] of unit, text and whether one begins."""

    x: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, texts: list[np.ndarray], lanes: int) -> Lanes:
        sizes = np.array([len(t) for t in texts])
        lanes = max(1, min(lanes, len(texts), int(sizes.sum()) // 64 + 1))
        load, place = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
        for i in np.argsort(-sizes, kind="stable"):
            k = int(load.argmin())
            place[k].append(i)
            load[k] += sizes[i]
        order = np.argsort(-load, kind="stable")
        x = np.zeros((load.max(), lanes), np.int32)
        doc, first = np.zeros_like(x), np.zeros(x.shape, bool)
        for lane, k in enumerate(order):
            at = 0
            for i in place[k]:
                x[at : at + sizes[i], lane], doc[at : at + sizes[i], lane], first[at, lane] = texts[i], i, True
                at += sizes[i]
        return cls(x, doc, first, load[order])

    def windows(self, length: int = WINDOW) -> Iterator[tuple[slice, int]]:
        """Steps and the number of lanes that are full through all of them."""
        cuts = sorted({*range(0, len(self.x), length), *(int(n) for n in np.unique(self.lengths))})
        for a, b in zip(cuts, cuts[1:]):
            yield slice(a, b), int((self.lengths >= b).sum())


def train(model: GatedModel, texts: list[np.ndarray], lanes: int = LANES, rate: float = RATE) -> int:
    """One pass of Adam over ``texts``, in place, with steps that shrink to a tenth; returns the tokens learnt from."""
    laid = Lanes.of(texts, min(lanes, max(16, sum(map(len, texts)) // 6000)))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    h = np.zeros((laid.x.shape[1], model.p["u"].shape[0]), np.float32)
    windows = list(laid.windows())
    for step, (at, n) in enumerate(windows):
        x = laid.x[at, :n]
        grad, h = model.gradients(x, laid.first[at, :n], h[:n])
        pace = rate * max(0.1, 1 - step / len(windows)) * math.sqrt(1 - 0.995 ** (step + 1)) / (1 - 0.9 ** (step + 1))
        for k, g in grad.items():
            g /= x.size
            m, v = moments[k]
            m *= 0.9
            v *= 0.995
            m += 0.1 * g
            g *= g
            g *= 0.005
            v += g
            np.sqrt(v, out=g)
            g += 1e-6
            np.divide(m, g, out=g)
            g *= pace
            model.p[k] += g
    return int(laid.lengths.sum())


def log_likelihoods(model: GatedModel, texts: list[np.ndarray], lanes: int = 2 * LANES) -> np.ndarray:
    """ln P of the units of each whole text."""
    laid, out = Lanes.of(texts, lanes), np.zeros(len(texts))
    h = np.zeros((laid.x.shape[1], model.p["u"].shape[0]), np.float32)
    for at, n in laid.windows():
        x = laid.x[at, :n]
        states, _ = model.run(x, laid.first[at, :n], h[:n])
        h = states[-1]
        logp, _, _ = model.outputs(states[:-1].reshape(-1, h.shape[1]), x.ravel(), False)
        out += np.bincount(laid.doc[at, :n].ravel(), logp, len(texts))
    return out


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 1. A null id counts as empty text: 0, so it is learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _squeezed(values: np.ndarray) -> bytes:
    """Positions of words, compressed: common words come early in a block's list, so most bytes are alike."""
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _loosened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int32)


def tokenised(rows: DataFrame) -> DataFrame:
    """Blocks of ``rows`` (doc_id, text, train): block, doc_ids, keys (of each text, by id and text), train, lengths,
    ids (all texts end to end, positions in words), words (hashes), n (count of each word in training texts), endings
    (of each word)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, size = TaskContext.get().partitionId(), 0, 0
        index: defaultdict = defaultdict(itertools.count().__next__)
        ids, keys, train, texts = [], [], [], []

        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        def block() -> pa.RecordBatch:
            every = np.concatenate(texts)
            flags, lengths = np.array(train, bool), np.array([len(t) for t in texts], np.int32)
            order = np.argsort(-np.bincount(every, minlength=len(index)), kind="stable")  # commonest first
            place = np.empty(len(index), np.int32)
            place[order] = np.arange(len(index), dtype=np.int32)
            n = np.bincount(every[np.repeat(flags, lengths)], minlength=len(index))[order]
            hashes = np.fromiter(map(word_hash, index), np.int64, len(index))[order]
            endings = np.fromiter(map(ending, index), np.int16, len(index))[order]
            columns = [pa.array([task << 24 | number], pa.int64()), one(pa.concat_arrays(ids)), one(pa.array(keys, pa.int64())), one(pa.array(flags)), one(pa.array(lengths)), pa.array([_squeezed(place[every])], pa.binary()), one(pa.array(hashes)), one(pa.array(n.astype(np.int32))), one(pa.array(endings))]
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "keys", "train", "lengths", "ids", "words", "n", "endings"])

        for batch in batches:
            flags, hashed = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, text in enumerate(batch.column(1)):
                words = tokens(text.as_py())
                texts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                ids.append(batch.column(0).slice(i, 1))
                keys.append(hashed[i])
                train.append(flags[i])
                size += 6 * len(words)
                if size >= BLOCK_BYTES:
                    yield block()
                    index = defaultdict(itertools.count().__next__)
                    ids, keys, train, texts, number, size = [], [], [], [], number + 1, 0
        if texts:
            yield block()

    key = F.xxhash64("doc_id", "text")
    return rows.select("doc_id", "text", "train", key.alias("key")).mapInArrow(run, f"block bigint, doc_ids array<{kind}>, keys array<bigint>, train array<boolean>, lengths array<int>, ids binary, words array<bigint>, n array<int>, endings array<smallint>")


@dataclass
class Units:
    """Which unit a word is, by its hash if it has one of its own, else by its ending. ``masses``: half counts of
    the words that share each ending, known and unknown."""

    hashes: np.ndarray
    places: np.ndarray
    endings: np.ndarray
    masses: np.ndarray
    counts: list[float]

    @classmethod
    def of(cls, own: list[tuple[int, int]], shared: dict[int, tuple[int, int]]) -> Units:
        """From (hash, count) of the common words, and (tokens, words) of each ending's other ones."""
        masses = np.full(ENDINGS, 0.5)
        for k, (n, v) in shared.items():
            masses[k] += n + 0.5 * v
        counts = np.concatenate([np.array([c for _, c in own], float), masses - 0.5])
        order = np.lexsort((np.arange(len(counts)), -counts))
        place = np.empty(len(counts), np.int32)
        place[order] = np.arange(len(counts), dtype=np.int32)
        hashes = np.array([h for h, _ in own], np.int64)
        by_hash = np.argsort(hashes)
        return cls(hashes[by_hash], place[: len(own)][by_hash], place[len(own) :], masses, counts[order].tolist())

    def find(self, words: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit of each word, and whether others share it."""
        out, shared = self.endings[endings], np.ones(len(words), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            own = self.hashes[at] == words
            out[own], shared[own] = self.places[at[own]], False
        return out, shared


def _values(cell: pa.Scalar) -> np.ndarray:
    return cell.values.to_numpy(zero_copy_only=False)


def _texts(units: np.ndarray, ids: bytes, lengths: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The units of each text of a block, and its words' positions in the block's list."""
    places = _loosened(ids, int(lengths.sum()))
    return np.split(units[places], np.cumsum(lengths)[:-1]), places


def _groups(blocks: DataFrame, held, groups: int) -> DataFrame:
    """(grp, key, units) of every training text, written out; the group follows from the text's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: Units = held.value
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {name: batch.column(name)[i] for name in batch.schema.names}
                of_words, _ = units.find(_values(cell["words"]), _values(cell["endings"]))
                texts, _ = _texts(of_words.astype("<u2"), cell["ids"].as_py(), _values(cell["lengths"]))
                flags, keys = _values(cell["train"]), _values(cell["keys"])
                mine = [t.tobytes() for t, f in zip(texts, flags) if f]
                yield pa.RecordBatch.from_arrays([pa.array(keys[flags] % groups, pa.int64()), pa.array(keys[flags]), pa.array(mine, pa.binary())], ["grp", "key", "units"])

    return blocks.select("keys", "train", "lengths", "ids", "words", "endings").mapInArrow(run, "grp bigint, key bigint, units binary")


def _average(trained: DataFrame, groups: int) -> np.ndarray | None:
    """The mean of all parameters, weighted by tokens: neighbours are merged by FAN_IN until few are left."""

    def merge(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("grp").to_numpy(), kind="stable")
        weights = table.column("weight").to_numpy()[order]
        total = int(weights.sum())
        mean = sum(np.frombuffer(table.column("values")[int(i)].as_py(), np.float32).astype(float) * (w / total) for i, w in zip(order, weights))
        return pa.table({"grp": table.column("near").slice(0, 1), "weight": pa.array([total], pa.int64()), "values": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

    while groups > FAN_IN:
        groups = -(-groups // FAN_IN)
        before, near = trained, F.floor(F.col("grp") / FAN_IN).cast("bigint")
        trained = saved(trained.withColumn("near", near).groupBy("near").applyInArrow(merge, "grp bigint, weight bigint, values binary"))
        discard(before)
    rows = sorted(trained.collect(), key=lambda r: r["grp"])  # at most FAN_IN sets of parameters
    discard(trained)
    total = sum(r["weight"] for r in rows)
    return sum(np.frombuffer(r["values"], np.float32).astype(float) * (r["weight"] / total) for r in rows) if total else None


def fit(blocks: DataFrame, units: Units, size: int = UNITS) -> GatedModel:
    """Learns from every training text of ``blocks`` once; a model of as many state units as ``size``."""
    spark = blocks.sparkSession
    model = GatedModel.initial(units.counts, size)
    shapes = [(k, v.shape) for k, v in model.p.items()]
    n_train = sum(units.counts)
    groups = max(1, int(n_train / GROUP_TOKENS + 0.5))
    held = spark.sparkContext.broadcast(units)  # as many as there are units, whatever the corpus
    # Dealt to a task for each group; sorted, so that the order does not depend on where texts came from.
    dealt = saved(_groups(blocks, held, groups).repartition(groups, "grp").sortWithinPartitions("grp", "key"))
    low = 0
    for share in SHARES:
        high = int(groups * share + 0.5) if share < 1 else groups
        if high == low:
            continue
        start = spark.sparkContext.broadcast(model.p)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            done: dict[int, list] = {}
            group, texts, waiting = None, [], 0

            def learn() -> None:
                model, weight = done.setdefault(group, [GatedModel(start.value).copy(), 0])
                done[group][1] = weight + train(model, texts)

            def result() -> pa.RecordBatch:
                model, weight = done.pop(group)
                values = np.concatenate([v.ravel() for v in model.p.values()]).astype(np.float32).tobytes()
                return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([weight], pa.int64()), pa.array([values], pa.binary())], ["grp", "weight", "values"])

            for batch in batches:
                for g, text in zip(batch.column("grp").to_pylist(), batch.column("units")):
                    # A group far above the mean, as when one row repeats without end, is learnt from in stretches.
                    if texts and (g != group or waiting >= 2 * GROUP_TOKENS):
                        learn()
                        texts, waiting = [], 0
                    if group is not None and g != group:
                        yield result()
                    group = g
                    texts.append(np.frombuffer(text.as_py(), "<u2").astype(np.int32))
                    waiting += len(texts[-1])
            if texts:
                learn()
                yield result()

        # A group's rows stand in one file, in order.
        mine = dealt.where((F.col("grp") >= low) & (F.col("grp") < high))
        trained = saved(mine.select("grp", "units").mapInArrow(run, "grp bigint, weight bigint, values binary"))
        flat = _average(trained, groups)
        if flat is not None:
            at = 0
            for k, shape in shapes:
                length = int(np.prod(shape))
                model.p[k] = flat[at : at + length].reshape(shape).astype(np.float32)
                at += length
        low = high
    discard(dealt)
    return model


@dataclass
class Fitted:
    """Blocks and counts of a corpus, and the model learnt from it; n tokens and v distinct words are for training."""

    blocks: DataFrame
    counts: DataFrame
    n: int
    v: int
    units: Units
    model: GatedModel


def learn(docs: DataFrame, training: Column, size: int = UNITS) -> Fitted:
    """Counts all words of the rows that ``training`` selects, and fits the model to them."""
    prepare(docs.sparkSession)
    blocks = saved(tokenised(docs.select("doc_id", F.col("text").cast("string").alias("text"), training.alias("train"))))
    pairs = blocks.select(F.inline(F.arrays_zip("words", "n", "endings")).alias("word", "n", "ending"))
    counts = saved(pairs.where("n > 0").groupBy("word").agg(F.sum("n").alias("c"), F.first("ending").alias("ending")))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(sums["n"]), int(sums["v"])
    common = F.col("c") >= max(1.0, n * SHARE)
    own = [(r["word"], r["c"]) for r in counts.where(common).orderBy(F.desc("c"), "word").collect()]  # 1 / SHARE at most
    shared = {r["ending"]: (r["n"], r["v"]) for r in counts.where(~common).groupBy("ending").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}  # ENDINGS at most
    units = Units.of(own, shared)
    return Fitted(blocks, counts.select("word", "c"), n, v, units, fit(blocks, units, size) if n else GatedModel.initial(units.counts, size))


def score_texts(docs: DataFrame, training: Column, size: int = UNITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, score_per_token (log10) for each row.

    ``training`` selects the rows to learn from. Null text is empty: one end token. Null and repeated ids are
    allowed, repeated rows count and are scored each; other columns are not read. Texts are scored whole, however
    long. Without training rows every word is unknown and has probability 1 in the base. An empty table gives none.
    """
    fitted = learn(docs, training, size)
    return scored(fitted, docs.schema["doc_id"].dataType.simpleString())


def scored(fitted: Fitted, kind: str) -> DataFrame:
    """The result of ``score_texts``, from what was learnt; ``kind`` is the type of the ids."""
    blocks, n = fitted.blocks, fitted.n
    held = blocks.sparkSession.sparkContext.broadcast((fitted.model.p, fitted.units))
    every_log = math.log10(n + 0.5 * (fitted.v + 1))

    def score(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        p, units = held.value
        cell = {name: table.column(name)[0] for name in table.column_names}
        endings, lengths = _values(cell["endings"]), _values(cell["lengths"])
        of_words, shared = units.find(_values(cell["words"]), endings)
        texts, places = _texts(of_words, cell["ids"].as_py(), lengths)
        c = np.zeros(len(of_words))
        c[known.column("pos").to_numpy()] = known.column("c").to_numpy()
        logs = np.log10(c + 0.5)
        inside = np.where(shared, logs - np.log10(units.masses[endings]), 0.0)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        per_text = lambda x: np.add.reduceat(x[places], starts)  # noqa: E731  no text is without its end token
        neural = log_likelihoods(GatedModel(p), texts) / math.log(10)
        out = {"doc_id": cell["doc_ids"].values, "train": cell["train"].values, "n_tokens": pa.array(lengths.astype(np.int64)), "n_known": pa.array(per_text((c > 0).astype(np.int64)))}
        return pa.table({**out, "base_score": pa.array(per_text(logs) - lengths * every_log), "score": pa.array(neural + per_text(inside))})

    words = blocks.select(F.col("block").alias("at"), F.posexplode("words").alias("pos", "word"))
    found = words.join(fitted.counts, "word").select("at", "pos", "c")
    texts = blocks.select("block", "doc_ids", "train", "lengths", "ids", "words", "endings")
    rows = texts.groupBy("block").cogroup(found.groupBy("at")).applyInArrow(score, f"doc_id {kind}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", (F.col("score") / F.col("n_tokens")).alias("score_per_token"))


def score_documents(docs: DataFrame) -> DataFrame:
    """``score_texts``, learning from all but the held-out fifth."""
    return score_texts(docs, ~held_out(F.col("doc_id")))
