"""Exact quantiles of columns and groups too large for one task."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rows import joined_to_groups, named, with_running_total

#: Values that one job reads quantiles from directly, of all its columns together.
FEW = 1_000_000
#: Values of a bracket up to which it is not narrowed further.
NARROW = 20_000
#: Accuracy of the sketches that narrow a bracket: the rank of a bound is off by at most rows / ACCURACY.
ACCURACY = 1000
#: Columns looked at in one job, and jobs at a time.
BATCH, JOBS = 25, 8


@dataclass
class _Bracket:
    """Where the value of one rank lies: strictly between ``low`` and ``high``, with ``inside`` values between them
    and ``below`` ones up to ``low``."""

    column: str
    rank: int
    below: int
    inside: int
    low: float | None = None
    high: float | None = None
    found: float | None = None

    def values(self) -> Column:
        x, within = F.col(self.column), F.lit(True)
        if self.low is not None:
            within = within & (x > self.low)
        if self.high is not None:
            within = within & (x < self.high)
        return F.when(within, x)


def _ranks(p: float, n: int) -> tuple[int, int, float]:
    """The ranks on both sides of a quantile of n values, and the share of the upper one."""
    at = p * (n - 1)
    low = min(math.floor(at), n - 1)
    return low, min(low + 1, n - 1), at - low


def _narrow(df: DataFrame, open_: list[_Bracket]) -> None:
    """Sketched bounds around each rank, then counts, which say on which side of them the rank lies for certain."""
    bounds = []
    for i, b in enumerate(open_):
        at = (b.rank - b.below + 0.5) / b.inside
        slack = 2 / ACCURACY
        bounds.append(F.percentile_approx(b.values(), [max(at - slack, 0.0), min(at + slack, 1.0)], ACCURACY).alias(f"b{i}"))
    ends = df.agg(*bounds).first()
    counts = []
    for i, b in enumerate(open_):
        x = b.values()
        for j, end in enumerate(ends[f"b{i}"]):
            counts += [F.count_if(x < end).alias(f"l{i}_{j}"), F.count_if(x == end).alias(f"e{i}_{j}")]
    row = df.agg(*counts).first()
    for i, b in enumerate(open_):
        at, low, high, below, inside = b.rank - b.below, b.low, b.high, b.below, b.inside
        for j, end in enumerate(ends[f"b{i}"]):
            less, equal = row[f"l{i}_{j}"], row[f"e{i}_{j}"]
            if less <= at < less + equal:
                b.found = end
            elif at >= less + equal and (low is None or end > low):
                low, below = end, b.below + less + equal
            elif at < less and (high is None or end < high):
                high, inside = end, less
        b.low, b.high, b.inside, b.below = low, high, inside - (below - b.below), below


def _packed(sizes: Mapping[str, int]) -> list[list[str]]:
    """The columns in runs of at most FEW values together."""
    runs: list[list[str]] = []
    room = -1
    for c, n in sizes.items():
        if n > room:
            runs.append([])
            room = FEW
        runs[-1].append(c)
        room -= n
    return runs


def quantiles(df: DataFrame, columns: Mapping[str, Column], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of all rows, interpolated between neighbours, for each named numeric expression.

    Null and NaN do not count; without values a quantile is None. A column of up to FEW values is read whole, any other
    is narrowed: mergeable sketches bound each rank, counts confirm the bounds, and a value that repeats without end is
    settled by its count. So no task holds more than sketches and FEW values, nothing else is shuffled, and each round
    leaves some hundredth of the rows. Several columns share a job.
    """
    names = list(columns)
    parts = [names[start : start + BATCH] for start in range(0, len(names), BATCH)]
    with ThreadPoolExecutor(JOBS) as pool:
        found = list(pool.map(lambda part: _quantiles(df, {n: columns[n] for n in part}, list(shares)), parts))
    return {n: v for some in found for n, v in some.items()}


def _quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> dict[str, list[float | None]]:
    plain = [x.cast("double") for x in columns.values()]
    data = df.select(*[F.when(~F.isnan(x), x).alias(f"c{i}") for i, x in enumerate(plain)])
    sizes = data.agg(*[F.count(c).alias(c) for c in data.columns]).first().asDict()
    read: dict[str, list[float]] = {}
    for some in _packed({c: n for c, n in sizes.items() if n <= FEW}):
        read |= data.agg(*[F.percentile(c, shares).alias(c) for c in some]).first().asDict()
    brackets = {(c, r): _Bracket(c, r, 0, n) for c, n in sizes.items() if n > FEW for p in shares for r in _ranks(p, n)[:2]}
    while wide := [b for b in brackets.values() if b.found is None and b.inside > NARROW]:
        _narrow(data, wide)
    few = {f"v{i}": b for i, b in enumerate(b for b in brackets.values() if b.found is None)}
    for some in _packed({v: b.inside for v, b in few.items()}):
        # The middle of the rank's own share, so that no rounding meets a neighbour.
        at = {v: (few[v].rank - few[v].below + 0.5) / few[v].inside for v in some}
        disc = [F.expr(f"percentile_disc({at[v]!r}D) within group (order by {v})").alias(v) for v in some]
        row = data.select(*[few[v].values().alias(v) for v in some]).agg(*disc).first()
        for v in some:
            few[v].found = row[v]
    out = {}
    for n, c in zip(columns, data.columns):
        out[n] = list(read[c] or [None] * len(shares)) if c in read else [_between(brackets, c, *_ranks(p, sizes[c])) for p in shares]
    return out


def _between(brackets: dict[tuple[str, int], _Bracket], column: str, low: int, high: int, share: float) -> float:
    a, b = brackets[column, low].found, brackets[column, high].found
    return a if share == 0 else (1 - share) * a + share * b


def grouped_medians(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """_part (the group; nulls are one) and _fill0, _fill1, ...: the exact medians of ``columns`` without null and NaN.

    Equal values are counted first; what is left is sorted over ranges of all groups and columns at once and summed up,
    so no task holds the values of a large group.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("i"), named(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    long = df.select(named(group).alias("_part"), F.explode(cells).alias("x")).select("_part", "x.i", "x.v")
    counts = long.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("_part", "i", "v").agg(F.count(F.lit(1)).alias("n"))
    summed = with_running_total(counts, [F.col("_part").asc_nulls_first(), F.col("i"), F.col("v")], "n", "_end")
    sizes = summed.groupBy(F.col("_part").alias("_p"), F.col("i").alias("_i")).agg(F.min(F.col("_end") - F.col("n")).alias("_begin"), F.sum("n").alias("_size"))
    placed = joined_to_groups(summed, sizes, {"_part": "_p", "i": "_i"})
    first, end = F.col("_end") - F.col("n") - F.col("_begin"), F.col("_end") - F.col("_begin")
    low, high = F.expr("(_size - 1) div 2"), F.expr("_size div 2")
    holds = lambda rank: (first <= rank) & (rank < end)
    middle = [((F.max(F.when(holds(low) & (F.col("i") == i), F.col("v"))) + F.max(F.when(holds(high) & (F.col("i") == i), F.col("v")))) / 2).alias(f"_fill{i}") for i in range(len(columns))]
    return placed.where(holds(low) | holds(high)).groupBy("_part").agg(*middle)
