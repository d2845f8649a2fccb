"""Connected components by alternating neighbourhood minima and pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of any comparable type, undirected -> (node, label): the smallest node reachable.

    Each round replaces a node's label by the least label among itself, its neighbours and its label's own
    label, so the rounds grow with the logarithm of a chain's length in practice. Every round is written to
    the shared folder. Self-links, repeats and nulls in ``edges`` are allowed; nulls link nothing.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    both = saved(both.select("a", "b").union(both.select("b", "a")).distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        step = labels.join(near, "node", "left").join(jump, "label", "left")
        new = saved(step.select("node", F.least("label", "near", "jump").alias("label"), (F.least("near", "jump") < F.col("label")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels
