"""Columns, cleaning, extremes and reshaping.

Decisions that need statistics take one aggregate job over all columns; everything else stays lazy.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AmbiguousArgumentError, DataError, DuplicationError, MissingArgumentError
from ..functions.text import snake_name
from ..rows import is_missing, is_numeric, named, require_columns


#: Values that a table can be widened by; more are an error.
MOST_WIDENED = 10_000
#: Pairs of columns counted in one job: each distinct count multiplies the rows.
PAIRS_AT_ONCE = 32


def select_columns(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    require_columns(df, include or [])
    return df.select(*[named(c) for c in (include or df.columns) if c not in (exclude or [])])


def move_columns(df: DataFrame, to: str, columns: str | list[str]) -> DataFrame:
    columns = [columns] if isinstance(columns, str) else columns
    require_columns(df, columns)
    rest = [c for c in df.columns if c not in columns]
    if to not in ("front", "back"):
        raise MissingArgumentError("to is front or back")
    return df.select(*map(named, columns + rest if to == "front" else rest + columns))


def bring_to_front(df: DataFrame, columns: str | list[str]) -> DataFrame:
    return move_columns(df, "front", columns)


def send_to_back(df: DataFrame, columns: str | list[str]) -> DataFrame:
    return move_columns(df, "back", columns)


def standardize_columns(df: DataFrame, camel_to_snake: bool = True) -> DataFrame:
    names = [snake_name(c, camel_to_snake) for c in df.columns]
    if len(set(names)) < len(names):
        raise DuplicationError(f"names coincide: {sorted({n for n in names if names.count(n) > 1})}")
    return df.toDF(*names)


def reset_column_index(df: DataFrame) -> DataFrame:
    return df.toDF(*map(str, range(len(df.columns))))


def find_duplicated_columns(df: DataFrame) -> list[str]:
    """The second and later occurrences of each name."""
    return [c for i, c in enumerate(df.columns) if c in df.columns[:i]]


def columns_are_unique(df: DataFrame) -> bool:
    return len(set(df.columns)) == len(df.columns)


def set_value_where(df: DataFrame, columns: str | list[str], value, where: Column) -> DataFrame:
    columns = [columns] if isinstance(columns, str) else columns
    return df.withColumns({c: F.when(where, F.lit(value)).otherwise(named(c)) for c in columns})


def missing_counts(df: DataFrame, columns: list[str] | None = None) -> dict[str, int]:
    """Rows in which each column is missing, in one job."""
    columns = columns or df.columns
    row = df.agg(*[F.count_if(is_missing(df, c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return dict(zip(columns, row))


def columns_with_missing(df: DataFrame, only_numeric: bool = False) -> list[str]:
    return [c for c, n in missing_counts(df).items() if n and (not only_numeric or is_numeric(df, c))]


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_numeric(df, c)]


def fill_na(df: DataFrame, value=0, columns: list[str] | None = None, except_columns: list[str] | None = None, suffix: str = "_na", as_int: bool = False) -> DataFrame:
    """For each column with missing values: a flag column, and the constant in their place."""
    chosen = [c for c in (columns or df.columns) if c not in (except_columns or [])]
    new = {}
    for c, n in missing_counts(df, chosen).items():
        if n:
            flag = is_missing(df, c)
            new[c + suffix] = flag.cast("int") if as_int else flag
            new[c] = F.when(flag, F.lit(value)).otherwise(named(c))
    return df.withColumns(new)


def as_int(c: Column) -> Column:
    """Digits only; signs, decimals and the rest become null."""
    s = c.cast("string")
    return F.when(s.rlike(r"^[0-9]+$"), s.try_cast("bigint"))


def as_numeric(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def as_string(c: Column) -> Column:
    return c.cast("string")


def _extreme(df: DataFrame, columns: list[str], skip_na: bool, largest: bool) -> Column:
    require_columns(df, columns)
    cells = [F.when(~is_missing(df, c), named(c)) for c in columns]
    best = cells[0] if len(cells) == 1 else (F.greatest if largest else F.least)(*cells)
    if skip_na:
        return best
    any_missing = is_missing(df, columns[0])
    for c in columns[1:]:
        any_missing = any_missing | is_missing(df, c)
    return F.when(~any_missing, best)


def row_min(df: DataFrame, columns: list[str], skip_na: bool = True) -> Column:
    """The least value of a row; with ``skip_na=False`` null if any is missing."""
    return _extreme(df, columns, skip_na, False)


def row_max(df: DataFrame, columns: list[str], skip_na: bool = True) -> Column:
    return _extreme(df, columns, skip_na, True)


def column_extremes(df: DataFrame, columns: list[str]) -> DataFrame:
    """min_ and max_ of each column, missing values skipped, one row."""
    clean = {c: F.when(~is_missing(df, c), named(c)) for c in columns}
    return df.agg(*[f(x).alias(f"{n}_{c}") for c, x in clean.items() for n, f in (("min", F.min), ("max", F.max))])


def single_value_columns(df: DataFrame, ignore: list[str] | None = None) -> list[str]:
    """Columns with one distinct value; missing is a value."""
    chosen = [c for c in df.columns if c not in (ignore or [])]
    # Exact and cheap: more than one value exactly if least and greatest differ or some are missing, not all.
    row = df.agg(*[e for i, c in enumerate(chosen) for e in (
        F.min(F.when(~is_missing(df, c), named(c))).alias(f"a{i}"), F.max(F.when(~is_missing(df, c), named(c))).alias(f"b{i}"), F.max(is_missing(df, c)).alias(f"m{i}"))]).first()
    return [c for i, c in enumerate(chosen) if row[f"a{i}"] == row[f"b{i}"] and not (row[f"m{i}"] and row[f"a{i}"] is not None) and row[f"m{i}"] is not None]


def drop_single_value_columns(df: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    return df.drop(*single_value_columns(df, ignore))


def drop_columns_with_too_many_nas(df: DataFrame, na_ratio: float, ignore: list[str] | None = None) -> DataFrame:
    """Drops columns of which a share of ``na_ratio`` or more is missing."""
    if na_ratio >= 1:
        raise AmbiguousArgumentError("na_ratio lies below 1")
    chosen = [c for c in df.columns if c not in (ignore or [])]
    row = df.agg(*[F.avg(is_missing(df, c).cast("int")).alias(f"c{i}") for i, c in enumerate(chosen)]).first()
    return df.drop(*[c for c, r in zip(chosen, row) if r is not None and r >= na_ratio])


def _counts(df: DataFrame, columns: list[str], pairs: list[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """Distinct values of tuples of columns, null a value; PAIRS_AT_ONCE in a job."""
    clean = {c: F.when(~is_missing(df, c), named(c)) for c in columns}
    out = {}
    for at in range(0, len(pairs), PAIRS_AT_ONCE):
        part = pairs[at : at + PAIRS_AT_ONCE]
        row = df.agg(*[F.count_distinct(F.struct(*[clean[c].alias(f"x{k}") for k, c in enumerate(p)])).alias(f"c{i}") for i, p in enumerate(part)]).first()
        out |= dict(zip(part, row))
    return out


def _useless(df: DataFrame, a: str, b: str, counts: dict) -> str | None:
    n_a, n_b, n_ab = counts[a,], counts[b,], counts[a, b]
    if n_a == n_b == n_ab:
        return a if is_numeric(df, b) and not is_numeric(df, a) else b
    return a if n_ab == n_b else b if n_ab == n_a else None


def get_useless_column(df: DataFrame, a: str, b: str) -> str | None:
    """Of two columns, the one that the other determines; of two that determine each other the one that is not
    numeric, else the second."""
    return _useless(df, a, b, _counts(df, [a, b], [(a,), (b,), (a, b)]))


def drop_columns_with_no_additional_information(df: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """Pairs of non-numeric columns from left to right; a dropped column is not compared again.

    Columns are counted one by one first. A pair has at least the values of its richer column and at most all rows,
    so a column that is one value throughout, or differs in every row, needs no count of pairs.
    """
    chosen = [c for c in df.columns if not is_numeric(df, c)]
    pairs = list(combinations(chosen, 2))
    if not pairs:
        return df
    counts, rows = _counts(df, chosen, [(c,) for c in chosen]), df.count()
    known = {p: rows for p in pairs if rows in (counts[p[0],], counts[p[1],])}
    known |= {(a, b): max(counts[a,], counts[b,]) for a, b in pairs if min(counts[a,], counts[b,]) <= 1}
    gone: list[str] = []
    for i, a in enumerate(chosen):
        # What is left to compare with ``a`` is counted together, columns that are gone by now left out.
        mine = [(a, b) for b in chosen[i + 1 :] if a not in gone and b not in gone]
        known |= _counts(df, chosen, [p for p in mine if p not in known])
        for _, b in mine:
            if a not in gone and b not in gone:
                x = _useless(df, a, b, counts | known)
                if x is not None and x not in (ignore or []):
                    gone.append(x)
    return df.drop(*gone)


def drop_bad_columns(df: DataFrame, na_ratio: float, ignore: list[str] | None = None) -> DataFrame:
    df = drop_single_value_columns(df, ignore)
    df = drop_columns_with_no_additional_information(df, ignore)
    return drop_columns_with_too_many_nas(df, na_ratio, ignore)


def count_missing_rows(df: DataFrame) -> DataFrame:
    """One row: with_missing, without_missing."""
    bad = F.lit(False)
    for c in df.columns:
        bad = bad | is_missing(df, c)
    return df.agg(F.count_if(bad).alias("with_missing"), F.count_if(~bad).alias("without_missing"))


def select_extreme(df: DataFrame, column: str, group_by: list[str] | None, largest: bool, tie: list[str | Column]) -> DataFrame:
    """The whole row of the largest or smallest value, overall or in each group; missing values never win.

    ``tie`` orders rows of equal value, first wins. Spark prunes each group before the shuffle to its best row.
    """
    present = df.where(~is_missing(df, column))
    value = named(column).desc() if largest else named(column).asc()
    if not group_by:
        return present.orderBy(value, *tie).limit(1)
    rank = F.row_number().over(Window.partitionBy(*map(named, group_by)).orderBy(value, *tie))
    return present.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def select_max(df: DataFrame, column: str, group_by: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    return select_extreme(df, column, group_by, True, tie or [])


def select_min(df: DataFrame, column: str, group_by: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    return select_extreme(df, column, group_by, False, tie or [])


def long_to_wide(df: DataFrame, index: list[str], widen: str, values: list[str], widen_values: list | None = None, agg=None) -> DataFrame:
    """One column ``<value>_<widened>`` for each value column and widened value, of which there may be MOST_WIDENED.

    A cell may come from one row only, unless ``agg`` says how to reduce several. Giving ``widen_values``
    saves the job that looks for them.
    """
    if agg is None:
        clash = df.groupBy(*map(named, (*index, widen))).count().where("count > 1").limit(1).count()
        if clash:
            raise DataError("several rows for one cell")
    reduce = agg or F.first
    if widen_values is None:
        found = df.select(named(widen).alias("w")).where("w is not null").distinct().limit(MOST_WIDENED + 1).collect()
        if len(found) > MOST_WIDENED:
            raise DataError(f"more than {MOST_WIDENED} values to widen by; a table cannot have that many columns")
        widen_values = sorted(r[0] for r in found)
    cells = [reduce(F.when(named(widen) == w, named(v)), **({} if agg else {"ignorenulls": True})).alias(snake_name((v, w))) for v in values for w in widen_values]
    return df.groupBy(*map(named, index)).agg(*cells)


def split_rows(df: DataFrame, column: str, sep: str = ",", name: str | None = None, keep_original: bool = False) -> DataFrame:
    """One row for each separated part, stripped; a null stays one row."""
    part = F.explode_outer(F.split(F.regexp_replace(F.trim(named(column)), rf"\s*\Q{sep}\E\s*", sep), rf"\Q{sep}\E"))
    out = df.withColumn("_part", part)
    if not keep_original:
        out = out.drop(column)
    return out.withColumnRenamed("_part", name or column)


class DataSlice:
    """Named columns and row ids of a table, checked at once and read lazily. Slices of slices refer to the
    first table; ``rows`` is a one-column DataFrame of ids, so any number of them stays distributed."""

    def __init__(self, df: DataFrame, columns: list[str] | None = None, rows: DataFrame | None = None, row_id: str | None = None):
        require_columns(df, columns or [])
        if rows is not None and row_id is None:
            raise MissingArgumentError("rows need the column of their ids")
        self.source, self.columns, self.rows, self.row_id = df, columns or df.columns, rows, row_id

    @property
    def data(self) -> DataFrame:
        out = self.source if self.rows is None else self.source.join(self.rows, self.row_id, "left_semi")
        return out.select(*map(named, self.columns))

    @property
    def shape(self) -> tuple[int, int]:
        return self.data.count(), len(self.columns)

    def slice(self, columns: list[str] | None = None, rows: DataFrame | None = None) -> DataSlice:
        if columns and not set(columns) <= set(self.columns):
            require_columns(self.data, columns)
        if rows is not None and self.rows is not None:
            rows = rows.join(self.rows, self.row_id, "left_semi")
        return DataSlice(self.source, columns or self.columns, self.rows if rows is None else rows, self.row_id)

    def content_hash(self) -> str:
        from ..functions.hashing import hash_rows

        return hash_rows(self.data).first()[0]


class SliceTemplate:
    """Columns and row ids to be applied to any table; None means all. ``&`` intersects two templates."""

    def __init__(self, columns: list[str] | None = None, rows: DataFrame | None = None, row_id: str | None = None):
        self.columns, self.rows, self.row_id = columns, rows, row_id

    def get_slice(self, df: DataFrame) -> DataSlice:
        return DataSlice(df, self.columns, self.rows, self.row_id)

    def __and__(self, other: SliceTemplate) -> SliceTemplate:
        both = self.columns is not None and other.columns is not None
        columns = [c for c in self.columns if c in other.columns] if both else self.columns or other.columns
        key = self.row_id or other.row_id
        rows = self.rows.join(other.rows, key, "left_semi") if self.rows is not None and other.rows is not None else self.rows if other.rows is None else other.rows
        return SliceTemplate(columns, rows, key)


