"""Fitted and stateless operators on streams.

Nothing in this library keeps state between micro-batches: text and date functions, filling, and the transform
of fitted encoders apply to a streaming DataFrame as they are. Ordered operators refuse one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def transform_stream(stream: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for step in steps:
        stream = step(stream)
    return stream


def write_parquet(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Exactly-once files; with ``once`` it takes what is there and ends."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
