"""Row order, missing values and seeded order: what a DataFrame does not have by itself."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import DataError, MissingColumnsError
from .storage import saved


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise MissingColumnsError(f"no columns {gone}")


def named(column: str) -> Column:
    """A column by its whole name, dots and quotes included."""
    return F.col(f"`{column.replace('`', '``')}`")


def require_batch(df: DataFrame) -> None:
    """Operators that need an order of all rows cannot run on a stream."""
    if df.isStreaming:
        raise DataError("an ordered operator needs a bounded table")


def is_floating(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))


def is_numeric(df: DataFrame, column: str) -> bool:
    """Booleans count, as they do in the dataframes people come from."""
    return isinstance(df.schema[column].dataType, (T.NumericType, T.BooleanType))


def is_missing(df: DataFrame, column: str) -> Column:
    c = named(column)
    return c.isNull() | F.isnan(c) if is_floating(df, column) else c.isNull()


def no_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column."""
    return df.withColumns({c: F.when(~F.isnan(named(c)), named(c)) for c in df.columns if is_floating(df, c)})


def joined_to_groups(df: DataFrame, groups: DataFrame, keys: Mapping[str, str], how: str = "inner", null_safe: bool = True) -> DataFrame:
    """``df`` joined to a table with one row a group, by its columns and those of ``groups`` in ``keys``.

    The groups are written first, so that Catalyst plans with their true size: few are broadcast, where a join by key
    would put the whole of a large group into one task. Among many, skewed ones are split as in any join.
    """
    groups = saved(groups)
    same = F.lit(True)
    for mine, theirs in keys.items():
        a, b = df[f"`{mine.replace('`', '``')}`"], groups[f"`{theirs.replace('`', '``')}`"]
        same = same & (a.eqNullSafe(b) if null_safe else a == b)
    return df.join(groups, same, how)


def seeded_order(key: str | Column, seed: int = 42) -> Column:
    """A reproducible shuffle: order by this digest. Any SQL engine can compute the same."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))


def _ranged(df: DataFrame, order_by: list[str | Column]) -> DataFrame:
    """Rows sorted over ranges, with _range and _range_at, the range and the place in it.

    The ranges are written to the shared folder, because all passes over them must see the same ones, whatever
    executors are lost in between.
    """
    require_batch(df)
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("_m", F.monotonically_increasing_id())
    return saved(ranged.withColumn("_range", F.shiftright("_m", 33).cast("int")).withColumn("_range_at", F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m"))


def _offsets(ranged: DataFrame, size: Column) -> Column:
    """What lies in the ranges before a row's own; one number a range comes to the driver."""
    sizes = {r["_range"]: int(r["n"] or 0) for r in ranged.groupBy("_range").agg(size.alias("n")).collect()}
    starts, at = [], 0
    for p in range(max(sizes, default=0) + 1):
        starts.append(at)
        at += sizes.get(p, 0)
    return F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("_range") + 1)


def with_row_id(df: DataFrame, order_by: list[str | Column], name: str = "row_id") -> DataFrame:
    """Adds 0..n-1 in the order of ``order_by``, which must be unique for a defined result. No task sees more
    than its range."""
    ranged = _ranged(df, order_by)
    return ranged.withColumn(name, _offsets(ranged, F.count(F.lit(1))) + F.col("_range_at")).drop("_range", "_range_at")


def with_rank(df: DataFrame, group_by: list[str], order_by: list[str | Column], name: str) -> DataFrame:
    """Adds 1..n within each group in the order of ``order_by``; nulls are a group. Rows are numbered in ranges over
    all groups and each group's first number is taken off, so no task sees the whole of a large group."""
    numbered = with_row_id(df, [*[named(g).asc_nulls_first() for g in group_by], *order_by], "_row")
    begins = numbered.groupBy(*[named(g).alias(f"_g{i}") for i, g in enumerate(group_by)]).agg(F.min("_row").alias("_begin"))
    ranked = joined_to_groups(numbered, begins, {g: f"_g{i}" for i, g in enumerate(group_by)}).withColumn(name, F.col("_row") - F.col("_begin") + 1)
    return ranked.drop("_row", "_begin", *[f"_g{i}" for i in range(len(group_by))])


def first_rows(df: DataFrame, order_by: list[str | Column], n: int) -> DataFrame:
    """The first n rows, however many: a large limit would gather them in one task."""
    if n <= 100_000:
        return df.orderBy(*order_by).limit(n)
    return with_row_id(df, order_by, "_n").where(F.col("_n") < n).drop("_n")


def with_running_total(df: DataFrame, order_by: list[str | Column], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value``, a whole number, over all rows up to each, by ranges as in ``with_row_id``."""
    ranged = _ranged(df, order_by)
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy("_range_at").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn(name, _offsets(ranged, F.sum(value)) + inside).drop("_range", "_range_at")
