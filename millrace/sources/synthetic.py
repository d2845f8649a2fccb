"""Generated tables: regression data, combinations and argument grids."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def create_data(spark: SparkSession, num_rows: int, num_x_columns: int, noise: float = 1.0, seed: int = 42) -> DataFrame:
    """x_i normal with mean 1 and deviation 100; y0 = 1 + sum of (x_i squared modulo i); y = (y0 + 1)^2 / 1e5 + noise."""
    xs = {f"x_{i}": 1 + 100 * F.randn(seed + i) for i in range(1, num_x_columns + 1)}
    df = spark.range(num_rows).withColumns(xs)
    y0 = reduce(lambda a, i: a + F.pmod(F.col(f"x_{i}") * F.col(f"x_{i}"), F.lit(float(i))), range(1, num_x_columns + 1), F.lit(1.0))
    return df.withColumn("y", (y0 + 1) * (y0 + 1) / 1e5 + noise * F.randn(seed))


def combinations(**parts: DataFrame) -> DataFrame:
    """All combinations of the distinct values of one-column tables, named by the keywords."""
    tables = [df.toDF(name).distinct() for name, df in parts.items()]
    return reduce(lambda a, b: a.crossJoin(b), tables)


def _values(v: Any, rounds: int) -> list:
    if isinstance(v, tuple) and len(v) == 2:
        return [v[0] + (v[1] - v[0]) * i / max(rounds - 1, 1) for i in range(rounds)]
    if isinstance(v, tuple) and len(v) == 3:
        start, end, step = v
        return [start + i * step for i in range(int((end - start) / step + 1e-9) + 1)]
    if isinstance(v, list):
        return v
    return [0.9 * v, v, 1.1 * v]


def create_arguments(spark: SparkSession, rounds: int, arguments: dict[str, Any]) -> DataFrame:
    """A grid of arguments: (a, b) is ``rounds`` points, (a, b, c) steps of c, a list itself, a number it and a
    tenth below and above."""
    tables = [spark.createDataFrame([(float(x) if isinstance(x, (int, float)) else x,) for x in _values(v, rounds)], [k]) for k, v in arguments.items()]
    return reduce(lambda a, b: a.crossJoin(b), tables)
