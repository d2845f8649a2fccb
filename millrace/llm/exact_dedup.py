"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted, and a block's place in
that order is its integer name, so two blocks share a name only if their bytes are equal. Adjacent names are
then paired and the distinct pairs sorted and named the same way, level after level, until one name is left
for each text: (bytes, level, name) is an identity without collisions.

Sorting runs in ``BUCKETS`` ranges of a hash, so a name is ``rank * BUCKETS + bucket``: unique over all
buckets, a function of the data alone, and no task ever sorts the whole corpus. Names come back to the
documents by a join on the block's hash; only for hashes that several different blocks share (found by
counting, so never assumed away) is the join on the bytes themselves. A text that a third of all rows hold is
one row in the naming, thanks to partial aggregation, and a skewed side of a join, which adaptive execution
splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, packed_row, saved

BLOCK_BYTES = 4096
BUCKETS = 1 << 16
ROW = ["doc_id", "sha", "size"]


def identity_key(text: Column) -> Column:
    """sha256 of the normalised text (null: empty), raw."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    norm = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).cast("binary").alias("data"))
    whole = norm.select("doc_id", "data", F.unhex(F.sha2("data", 256)).alias("sha"), F.octet_length("data").cast("long").alias("size"))
    # An empty text is one empty block.
    at = F.sequence(F.lit(0), F.greatest((F.col("size") - 1) / block_bytes, F.lit(0)).cast("int"))
    cut = whole.select(*ROW, "data", F.explode(at).alias("pos"))
    block = F.substring("data", F.col("pos") * block_bytes + 1, F.lit(block_bytes))
    return cut.select(*ROW, "pos", block.alias("block")).withColumn("h", F.xxhash64("block"))


def _named(distinct: DataFrame, hashed: str, by: list[str]) -> DataFrame:
    """Adds the integer name to each of the distinct values ``by``, and how many of them share the hash."""
    placed = distinct.withColumn("bucket", F.pmod(hashed, F.lit(BUCKETS)))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*by))
    same = F.count(F.lit(1)).over(Window.partitionBy("bucket", hashed))
    return placed.withColumn("name", rank.cast("long") * BUCKETS + F.col("bucket")).withColumn("same", same)


def text_identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text) -> one row for each distinct (doc_id, normalised text): doc_id, sha, size, level, name,
    copies (rows that are equal in both). Equal (size, level, name) means equal normalised texts.

    Null texts count as empty; null and repeated ids are allowed.
    """
    blocks = _blocks(docs, block_bytes)
    names = _named(blocks.select("h", "block").distinct(), "h", ["h", "block"])
    names = saved(names.select("h", "name", "same", F.when(F.col("same") > 1, F.col("block")).alias("block")))
    alone = blocks.drop("block").join(names.where("same = 1").select("h", "name"), "h")
    if names.where("same > 1").limit(1).count():
        clash = names.where("same > 1").select("h", "block", "name")
        alone = alone.unionByName(blocks.join(clash, ["h", "block"]).drop("block"))
    level, done = 0, None
    rows = saved(alone.groupBy(*ROW, "pos").agg(F.max("name").alias("name"), F.count(F.lit(1)).alias("copies")))
    most = rows.agg(F.max("pos")).first()[0]
    width = F.greatest(F.ceil(F.col("size") / block_bytes), F.lit(1))
    while True:
        left = F.ceil(width / (1 << level))
        ended = rows.where(left == 1).select(*ROW, F.lit(level).alias("level"), "name", "copies")
        done = ended if done is None else done.unionByName(ended)
        if most is None or most < (1 << level):
            return done
        half = F.shiftright("pos", 1).alias("pos")
        odd = F.col("pos") % 2 == 1
        pairs = rows.where(left > 1).groupBy(*ROW, half).agg(F.max(F.when(~odd, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("r"), F.max("copies").alias("copies"))
        distinct = _named(pairs.select("l", "r").distinct().withColumn("h", F.xxhash64("l", "r")), "h", ["l", "r"])
        rows = saved(pairs.join(distinct.select("l", "r", "name"), ["l", "r"]).select(*ROW, "pos", "name", "copies"))
        level += 1


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when they are identical after lower-casing A-Z. Of equal texts the row with the largest
    doc_id stays (null ids only if there is no other). A row repeated with the same id stays once. Null text
    is empty text. Columns other than doc_id and text are neither read nor returned.
    """
    ids = saved(text_identities(docs.select("doc_id", "text"), block_bytes))
    key = ["size", "level", "name"]
    # Written first, so that both sides of the join are plain shuffles, whose hot keys Spark can split.
    groups = saved(ids.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    # A null key cannot occur: size, level and name are never null.
    rows = ids.join(groups, key).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_dedup`` keeps: of equal texts the one with the largest id.

    Null texts are equal to empty ones; of rows that repeat an id and a text one stays, and null ids stay only where
    no equal text has an id. An empty table stays empty. Columns may have any names, dots included.
    """
    rows = saved(exact_dedup(docs))
    said = rows.where("kept").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha"))
    repeated = rows.where("not kept and doc_id <=> keep_id").limit(1).count()
    keyed = docs.select(packed_row(docs), identity_key(F.col("text")).alias("_key"))
    kept = keyed.join(said, keyed["row.doc_id"].eqNullSafe(said["_id"]) & (keyed["_key"] == said["_sha"]), "left_semi")
    if repeated:  # a row of the same id and text
        kept = kept.withColumn("_id", F.col("row.doc_id")).dropDuplicates(["_id", "_key"])
    return kept.select("row.*")
