"""Resharding by minimum-cost flow: the new layout moves the fewest bytes that the new capacities allow.

Rows are grouped into blocks, a fixed number in each old shard, so what the driver solves has a size that no
input changes. The flow network runs from old shards (supply: their bytes) to new ones (demand: their
capacity); an edge to the same shard is free, any other costs one for each byte. Its solution says how many
bytes each pair of shards exchanges; whole blocks, taken in a fixed order, then realise the flow, each new
shard ending within one block of its capacity. Files of shards that neither gain nor lose rows stand; the others'
are rewritten.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import saved

BLOCKS = 1024  # in each old shard


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units sent from each source to each sink at the least total cost; totals must agree.

    Successive shortest paths with Dijkstra on reduced costs over the bipartite residual graph; each path
    exhausts an edge or a node, so the number of paths is small for few shards.
    """
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ in total")
    n, m = len(supply), len(demand)
    flow = [[0] * m for _ in range(n)]
    left, need, price = list(supply), list(demand), [0] * (n + m)
    while any(left):
        dist, back = [float("inf")] * (n + m), [-1] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        for _, i in heap:
            dist[i] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            edges = ((n + j, cost[u][j]) for j in range(m)) if u < n else ((i, -cost[i][u - n]) for i in range(n) if flow[i][u - n])
            for v, c in edges:
                to = d + c + price[u] - price[v]
                if to < dist[v]:
                    dist[v], back[v] = to, u
                    heapq.heappush(heap, (to, v))
        end = min((n + j for j in range(m) if need[j]), key=lambda v: (dist[v] + price[v], v))
        reach = dist[end]
        price = [p + min(d, reach) for p, d in zip(price, dist)]
        path = [end]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:]))
        amount = min([left[path[0]], need[end - n]] + [flow[v][u - n] for u, v in steps if u >= n])
        for u, v in steps:
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
        left[path[0]] -= amount
        need[end - n] -= amount
    return flow


@dataclass(frozen=True)
class Transfer:
    """Where one block goes, and the slot at which its rows begin there."""

    old: int
    block: int
    shard: int
    first_slot: int


def plan_transfers(blocks: list[tuple[int, int, int, int]], capacities: list[int]) -> tuple[list[Transfer], list[list[int]]]:
    """``blocks``: (old shard, block, bytes, rows). Capacities are shares; they are scaled to the total bytes.

    Returns each block's place and the solved flow. Blocks of one old shard are dealt to its targets in order
    of block number; a target is full once its flow is met to within half a block. Rounding that this leaves
    is carried over to the next block, never lost.
    """
    olds = max((b[0] for b in blocks), default=-1) + 1
    n = max(olds, len(capacities))
    total = sum(b[2] for b in blocks)
    supply = [0] * n
    for old, _, size, _ in blocks:
        supply[old] += size
    share = sum(capacities) or 1
    edges = [total * sum(capacities[:j]) // share for j in range(len(capacities) + 1)]
    demand = [edges[j + 1] - edges[j] for j in range(len(capacities))]
    flow = min_cost_flow(supply, demand, [[int(i != j) for j in range(len(capacities))] for i in range(n)])
    # Sorting by size, largest first, lets the small blocks even out what the large ones leave open.
    owed = [row[:] for row in flow]
    place: dict[tuple[int, int], int] = {}
    for old, block, size, _ in sorted(blocks, key=lambda b: (-b[2], b[0], b[1])):
        best = max(range(len(capacities)), key=lambda j: (owed[old][j], j == old, -j))
        owed[old][best] -= size
        place[old, block] = best
    taken, out = [0] * len(capacities), []
    for old, block, _, rows in sorted(blocks):
        j = place[old, block]
        out.append(Transfer(old, block, j, taken[j]))
        taken[j] += rows
    return out, flow


def reshard(rows: DataFrame, old_shard: str, size: str, key: str, capacities: list[int], blocks: int = BLOCKS) -> DataFrame:
    """Adds shard, slot (gapless from 0 in each shard) and moved to ``rows``, which hold no shard, slot or
    moved column of their own. Old shards are small non-negative integers; a null one counts as 0.

    Ties in ``key`` are settled by size; rows equal in both may swap slots with each other, which leaves the
    result the same as a table. An empty table stays empty.
    """
    old = F.coalesce(F.col(old_shard), F.lit(0)).cast("int")
    placed = rows.withColumn("_old", old).withColumn("_block", F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int"))
    sizes = placed.groupBy("_old", "_block").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # at most old shards x blocks
    plan, _ = plan_transfers([(r["_old"], r["_block"], int(r["bytes"]), int(r["n"])) for r in sizes], capacities)
    schema = T.StructType([T.StructField("_old", T.IntegerType()), T.StructField("_block", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("_first", T.LongType())])
    where = rows.sparkSession.createDataFrame([(t.old, t.block, t.shard, t.first_slot) for t in plan], schema)
    in_block = F.row_number().over(Window.partitionBy("_old", "_block").orderBy(F.col(key).asc_nulls_first(), F.col(size)))
    return placed.join(F.broadcast(where), ["_old", "_block"]).withColumn("slot", F.col("_first") + in_block - 1).withColumn("moved", F.col("_old") != F.col("shard")).drop("_old", "_block", "_first")


def rewrite_affected(rows: DataFrame, path: str) -> None:
    """Writes the rows of every shard that gained or lost rows, one folder a shard; other shards' files stand.

    ``rows`` come from ``reshard`` with the old shard in ``old_shard``. Folders of shards that lost all their
    rows are deleted once the others are written. Rows are dealt to tasks by ranges of shard and slot, so a large
    shard is many files in order, and no task holds a whole one. Without moved rows nothing is written.
    """
    old = F.coalesce(F.col("old_shard"), F.lit(0)).cast("int")
    pairs = rows.groupBy(old.alias("old"), "shard").agg(F.max("moved").alias("moved")).collect()  # shard numbers, not rows
    hit = {k for r in pairs if r["moved"] for k in (r["old"], r["shard"])}
    rows.where(F.col("shard").isin(list(hit))).drop("moved", "old_shard").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    spark = rows.sparkSession
    for k in hit - {r["shard"] for r in pairs}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={k}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), old_shard, moved.

    The old layout deals documents by their source, as a crawl written site by site would be, so its shards
    differ widely in bytes; null sources lie in shard 0. Null text: size 1, crc 0. Law: ``bytes``.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    old = F.coalesce(F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(shards)), F.lit(0)).cast("int")
    narrow = saved(docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), old.alias("old_shard")))
    out = reshard(narrow, "old_shard", "size", "doc_id", [1] * shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")
