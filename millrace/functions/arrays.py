"""Functions of lists and ordered sets, on array columns."""

from __future__ import annotations

import itertools
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AmbiguousArgumentError, MissingArgumentError


def flatten(df: DataFrame, column: str) -> Column:
    """All levels; their number comes from the schema."""
    c, kind = F.col(column), df.schema[column].dataType
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        c, kind = F.flatten(c), kind.elementType
    return c


def has_duplicates(a: Column) -> Column:
    return F.size(F.array_distinct(a)) < F.size(a)


def get_duplicates(a: Column) -> Column:
    """Each value that occurs more than once, in order of first occurrence."""
    return F.filter(F.array_distinct(a), lambda x: F.size(F.filter(a, lambda y: y.eqNullSafe(x))) > 1)


def remove_duplicates(a: Column) -> Column:
    return F.array_distinct(a)


def intersection(a: Column, b: Column) -> Column:
    """Order and repeats of ``a`` stay, unlike in ``array_intersect``."""
    return F.filter(a, lambda x: F.array_contains(b, x))


def union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def product(*arrays: Column) -> Column:
    """All combinations, the first list varying slowest; elements are arrays."""
    out = F.transform(arrays[0], lambda x: F.array(x))
    for a in arrays[1:]:
        out = _extended(out, a)
    return out


def _extended(rows: Column, a: Column) -> Column:
    return F.flatten(F.transform(rows, lambda row: F.transform(a, lambda x: F.concat(row, F.array(x)))))


def powerset(a: Column) -> Column:
    """All subsets, by size, then by the positions of their members."""
    subsets = F.sequence(F.lit(0), (F.pow(F.lit(2.0), F.size(a)) - 1).cast("int"))
    places = F.filter(F.sequence(F.lit(0), F.size(a)), lambda i: i < F.size(a))
    picked = F.transform(subsets, lambda m: F.filter(places, lambda i: (m / F.pow(F.lit(2.0), i)).cast("int") % 2 == 1))
    ordered = F.array_sort(F.transform(picked, lambda p: F.struct(F.size(p).alias("n"), p.alias("p"))))
    return F.transform(ordered, lambda s: F.transform(s["p"], lambda i: F.get(a, i)))


def cumsum(a: Column) -> Column:
    zero = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("sum"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.array(s["sum"] + x)).alias("out"), (s["sum"] + x).alias("sum"))
    return F.aggregate(a, zero, step)["out"]


def canonical_map(m: Column) -> Column:
    """A map as its entries in order of keys: comparable, groupable, hashable."""
    return F.array_sort(F.map_entries(m))


def counter(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, count); the commonest first if ``top`` is given, ties by value."""
    counts = df.groupBy(F.col(column).alias("value")).count()
    return counts if top is None else counts.orderBy(F.desc("count"), F.asc("value")).limit(top)


def create_grid(grid: dict[str, Any]) -> list[dict[str, Any]]:
    """All combinations of the lists' values, the first key varying slowest; other values stand for themselves."""
    lists = [v if isinstance(v, (list, tuple, set)) else [v] for v in grid.values()]
    return [dict(zip(grid, x)) for x in itertools.product(*lists)]


def series(start: float, end: float | None = None, step: float | None = None, count: int | None = None, include_start: bool = True, include_end: bool = True) -> Column:
    """An arithmetic sequence as an array of doubles, falling if ``end`` is below ``start``."""
    if (step is None) == (count is None):
        raise AmbiguousArgumentError("give a step or a count, not both")
    if end is None:
        raise MissingArgumentError("an end is needed")
    if count is not None:
        gaps = count - 1 + (not include_start) + (not include_end)
        step = (end - start) / gaps if gaps else 0.0
        n = gaps
    else:
        step = abs(step) if end >= start else -abs(step)
        n = int((end - start) / step + 1e-9)
    points = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.lit(float(start)) + i * F.lit(float(step)))
    if not include_start:
        points = F.slice(points, 2, max(n, 0)) if n else F.slice(points, 1, 0)
    if not include_end:
        points = F.filter(points, lambda x: F.abs(x - F.lit(float(end))) > F.lit(abs(step) * 1e-9))
    return points
