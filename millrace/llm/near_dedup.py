"""MinHash near-deduplication with bottom-k sketches of one hash function.

A document is the set of its distinct five-word shingles; its sketch is the k smallest of their hashes.
Documents of the same set form a class, and only classes are compared.

Candidates come from inverted lists of the retained values. Two sets that are similar enough share at least
``OVERLAP`` values of their sketches (see there), so by the prefix argument they share one among the
``k - OVERLAP + 1`` rarest of each: only those are listed, which leaves values of common passages out. Each
list names a leader, the member with the fewest values of its own, and the lists of one leader are merged; a
pair that shares a listed value shares its leader.

Within a leader's members, estimates from union sketches, computed against all members at once, rule out
dissimilar pairs, and exact Jaccard on the full sets confirms the rest. Members that are connected already
need no more comparing, and only the confirmed links that join two parts leave a task.

Large leaders are cut into blocks. In a first pass each block is a task, together with the leader: work in
proportion to the members, which connects a family of near copies to its centre. Only members that this leaves
apart from their leader, the residue, go on: blocks of them meet each block of all members. So no task holds more
than two blocks, and only a family that really falls into many parts takes more than linear work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed_row, prepare, saved, sized_broadcast
from .graph import components

WORDS, K = 5, 64
#: Of 64 retained values, a pair of similarity 0.75 shares 48 on average with a standard deviation of 3.5; 26
#: lies 6.3 deviations below, a chance under 1e-9 for each pair. Sets of up to 48 shingles only match sets
#: that the sketch holds whole, and for them the exact bound ceil(0.75 n) holds without any chance.
OVERLAP, WHOLE = 26, 48
#: Shingles that a block of members holds on average, and candidates up to which their ids are broadcast.
BLOCK_SHINGLES, BROADCAST_CANDIDATES = 60_000, 200_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 17)
        return value


_HASHES = _WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles: of five words in a row, or of all words if there
    are fewer. Two shingles of a pair of documents collide with a chance of about 1e-11 at 20,000 words."""
    words = (text or "").encode().lower().split()  # bytes: lower-cases and splits in ASCII only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    w = min(WORDS, len(words))
    s = np.full(len(words) - w + 1, w, np.uint64)
    for i in range(w):
        s = (s ^ (s >> np.uint64(29))) * _MIX[i] + h[i : len(h) - w + 1 + i]
    s ^= s >> np.uint64(33)
    s *= np.uint64(0xFF51AFD7ED558CCD)
    s ^= s >> np.uint64(33)
    return np.unique(s)


def set_id(sorted_hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(sorted_hashes.tobytes())


def union_estimates(sketch: np.ndarray, others: np.ndarray, sizes: np.ndarray, k: int = K) -> np.ndarray:
    """Similarity of ``sketch`` (sorted) to each row of ``others`` (sorted, of ``sizes`` values, then filled up):
    the share of common values among the k smallest of both together."""
    at = np.searchsorted(sketch, others)
    common = (sketch[np.minimum(at, len(sketch) - 1)] == others) & (np.arange(others.shape[1]) < sizes[:, None])
    seen = np.cumsum(common, axis=1)
    rank = np.arange(1, others.shape[1] + 1) + at + common - seen
    union = np.minimum(k, sizes + len(sketch) - seen[:, -1])
    return (common & (rank <= k)).sum(1) / np.maximum(union, 1)


def spanning_links(sets: list[np.ndarray], part: np.ndarray | None = None, sources: np.ndarray | None = None, k: int = K) -> list[tuple[int, int]]:
    """Pairs of positions with exact Jaccard of 0.75 or more that connect all that such pairs connect.

    ``part``: numbers of parts that are connected already, none by default. ``sources``: looks for the pairs that
    have at least one of these members only."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    kept = np.minimum(sizes, k)
    sketches = np.full((m, k), np.iinfo(np.uint64).max, np.uint64)
    for i, s in enumerate(sets):
        sketches[i, : kept[i]] = s[:k]
    owner = np.repeat(np.arange(m), sizes)
    values, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.bincount(owner[count[number] > 1], minlength=m)
    order = np.argsort(number, kind="stable")
    posting = owner[order]
    begin = np.concatenate(([0], np.cumsum(count)))
    of = np.split(number, np.cumsum(sizes)[:-1])
    every = sources is None
    part = np.arange(m) if part is None else np.unique(part, return_inverse=True)[1]
    todo = (100 * shared >= 75 * sizes) & (True if every else sources)
    links: list[tuple[int, int]] = []
    rank = np.argsort(-shared / np.maximum(sizes, 1), kind="stable")
    while True:
        # Where all members are sources, those outside the largest part find what links it to them.
        open_ = rank[todo[rank] & (part[rank] != (np.bincount(part).argmax() if every else -1))]
        if not len(open_):
            return links
        d = open_[0]
        todo[d] = False
        fits = (part != part[d]) & (100 * np.minimum(sizes, sizes[d]) >= 75 * np.maximum(sizes, sizes[d]))
        near = np.flatnonzero(fits)
        near = near[union_estimates(sketches[d, : kept[d]], sketches[near], kept[near], k) >= OVERLAP / K] if len(near) else near
        if not len(near):
            continue
        hit = of[d][count[of[d]] > 1]
        lengths = count[hit]
        index = np.repeat(begin[hit] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        common = np.bincount(posting[index], minlength=m)[near]
        for x in near[100 * common >= 75 * (sizes[d] + sizes[near] - common)]:
            if part[x] != part[d]:
                links.append((int(d), int(x)))
                part[part == part[x]] = part[d]


def _text_hash() -> Column:
    """Tells apart the texts of one id, or of rows without an id; equal texts have equal sets."""
    return F.xxhash64(F.col("text").cast("string")).alias("text_hash")


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, set_id, n_shingles, sketch."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _HASHES.clear()  # what another task left
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(map(set_id, sets), pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array([s[:K].view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)
        _HASHES.clear()  # workers live on

    return docs.select("doc_id", _text_hash(), F.col("text").cast("string")).mapInArrow(run, schema)


def _leaders(classes: DataFrame) -> DataFrame:
    """(leader, node, n): the members of each leader's lists, itself included."""
    values = classes.select("node", "n", F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = values.join(often, "v").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))  # at most K
    held = F.least("n", F.lit(K))
    least = F.when(F.col("n") <= WHOLE, F.ceil(F.col("n") * 0.75)).otherwise(F.lit(OVERLAP))
    own = (held - F.size("vs")).cast("int")
    listed = F.slice("vs", 1, F.greatest((held - least + 1 - own).cast("int"), F.lit(0)))
    lists = saved(mine.select("node", "n", own.alias("own"), F.explode(listed).alias("x")).select("node", "n", "own", "x.v"))
    heads = lists.groupBy("v").agg(F.min(F.struct("own", "node")).alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1")
    return lists.join(heads.select("v", F.col("head.node").alias("leader")), "v").select("leader", "node", "n").distinct()


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the wanted (node, doc_id, text_hash, set_id), recomputed from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # rows that repeat an id and a text, or a text without an id
        for batch in batches:
            nodes, hashes = [], []
            for node, wants, text in zip(batch.column("node").to_pylist(), batch.column("set_id"), batch.column("text")):
                if node not in done and set_id(s := shingles(text.as_py())) == wants.as_py():
                    done.add(node)
                    nodes.append(node)
                    hashes.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(hashes, pa.binary())], ["node", "hashes"])
        _HASHES.clear()

    texts = docs.select(F.col("doc_id").alias("_id"), _text_hash().alias("_hash"), F.col("text").cast("string").alias("text"))
    found = texts.join(wanted, texts["_id"].eqNullSafe(wanted["doc_id"]) & (texts["_hash"] == wanted["text_hash"]))
    return found.select("node", "set_id", "text").mapInArrow(run, "node bigint, hashes binary")


def _blocks(members: DataFrame) -> DataFrame:
    """Adds to (leader, node, n) of leaders with two members or more: parts, the blocks of the leader, and block."""
    totals = members.groupBy("leader").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("m")).where("m > 1")
    sized = members.join(totals.select("leader", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("parts")), "leader")
    return sized.withColumn("block", F.pmod(F.xxhash64("node", "leader"), F.col("parts")).cast("int"))


def _first_tasks(blocks: DataFrame) -> DataFrame:
    """(leader, i, j, node, label, source): each block once, as block i, and the leader with each of its blocks."""
    leaders = blocks.select("leader", "parts").distinct().select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("leader").alias("node"))
    both = blocks.select("leader", F.col("block").alias("i"), "node").unionByName(leaders)
    return both.select("leader", "i", F.lit(-1).alias("j"), "node", F.col("node").alias("label"), F.lit(True).alias("source"))


def _residue_tasks(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """The same for members that are not connected to their leader of several blocks: block i of them (sources)
    with block j of all members. ``labels``: (node, label) of all nodes that have links so far."""
    named = blocks.where("parts > 1").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    leading = named.where("node = leader").select("leader", F.col("label").alias("led"))
    residue = saved(named.join(leading, "leader").where("label <> led").drop("led"))
    rests = residue.groupBy("leader").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("rests"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = residue.join(rests, "leader").select("leader", F.pmod(F.xxhash64("leader", "node"), F.col("rests")).cast("int").alias("i"), upto("parts").alias("j"), "node", "label", F.lit(True).alias("source"))
    others = named.join(rests, "leader").select("leader", upto("rests").alias("i"), F.col("block").alias("j"), "node", "label", F.lit(False).alias("source"))
    return mine.unionByName(others)


def _links(table: pa.Table) -> pa.Table:
    rows: dict[int, int] = {}
    sources: set[int] = set()
    for at, (node, source) in enumerate(zip(table.column("node").to_pylist(), table.column("source").to_pylist())):
        rows.setdefault(node, at)
        if source:
            sources.add(node)
    nodes = list(rows)
    hashes, labels = table.column("hashes"), table.column("label").to_numpy()
    sets = [np.frombuffer(hashes[at].as_py(), np.uint64) for at in rows.values()]
    only = None if len(sources) == len(nodes) else np.array([x in sources for x in nodes])
    found = spanning_links(sets, labels[list(rows.values())], only) if len(nodes) > 1 else []
    return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.int64()), "b": pa.array([nodes[j] for _, j in found], pa.int64())})


def _found(tasks: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) that the tasks confirm."""
    return saved(tasks.join(sets, "node").groupBy("leader", "i", "j").applyInArrow(_links, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links), kept (it is its own), set_id.

    Links join documents whose shingle sets have a Jaccard similarity of 0.75 or more. Null and empty texts
    have no shingles and link with nothing. Rows that repeat an id and a text share their fate; a null id
    belongs to its component but never names it, and is kept only where no id does. Other columns are not read.
    """
    return _decided(docs).drop("text_hash")


def _decided(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` and text_hash."""
    prepare(docs.sparkSession)
    seen = saved(_sketched(docs))
    some = seen.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("text_hash"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = saved(some.withColumn("node", F.monotonically_increasing_id()))  # written, so the numbers stay
    members = saved(_leaders(classes))
    blocks = saved(_blocks(members))
    wanted = saved(blocks.select("node").distinct().join(classes.select("node", "doc_id", "text_hash", "set_id"), "node"))
    sets = saved(_full_sets(docs, sized_broadcast(wanted, wanted.count(), BROADCAST_CANDIDATES)))
    links = _found(_first_tasks(blocks), sets)
    labels = components(links)
    if blocks.where("parts > 1").limit(1).count():
        more = saved(_residue_tasks(blocks, labels))
        if more.limit(1).count():
            labels = components(links.unionByName(_found(more, sets)))
    named = classes.select("set_id", "node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    told = named.join(least, "label").select("set_id", "component_id")
    out = seen.select("doc_id", "text_hash", "n_shingles", "set_id").join(told, "set_id", "left")
    alone = F.col("n_shingles") == 0
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "set_id", "text_hash")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept: of each component the rows with the smallest id.

    Rows are told apart by id and text, so texts that share an id, or have none, go or stay on their own. Null and
    empty texts stay; rows that repeat an id and a text share their fate; an empty table stays empty. Columns may
    have any names, dots included.
    """
    gone = saved(_decided(docs).where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    packed = docs.select(packed_row(docs), _text_hash())
    same = packed["row.doc_id"].eqNullSafe(gone["_id"]) & (packed["text_hash"] == gone["_hash"])
    return packed.join(sized_broadcast(gone, gone.count(), BROADCAST_CANDIDATES * 4), same, "left_anti").select("row.*")
