"""Equi-joins that keep order, keep what they drop, or keep types.

Strategy is Catalyst's: it broadcasts a side whose size it knows to be small and splits skewed keys otherwise. Where
repeated ids are removed, a key has at most one row that stays, so its rows are never multiplied with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AmbiguousArgumentError
from ..rows import joined_to_groups, named, require_columns


def _sides(left: DataFrame, right: DataFrame, left_id: str, right_id: str, on: list[str]) -> DataFrame:
    clash = [c for c in right.columns if c in left.columns and c not in on]
    if clash:
        raise AmbiguousArgumentError(f"columns of both sides: {clash}")
    require_columns(left, [left_id, *on])
    require_columns(right, [right_id, *on])
    return left


def _first_matches(mine: DataFrame, other: DataFrame, on: list[str], my_id: str, other_id: str, outer: bool = False, keep: str = "first", nulls_first: bool = False) -> DataFrame:
    """For each id of ``mine`` the first (or last) row of its join with ``other``: _mine and _other, the rows, and their ids
    _my_id and _other_id; _other is null where an outer join finds none. Linear: of ``other`` one row a key is all that
    can come first, and both maxima are taken in parts, so a large key or a repeated id is nobody's whole."""
    pick = F.max_by if keep == "last" else F.min_by
    whole = lambda df: F.struct(*map(named, df.columns))

    def order(c: Column) -> Column:
        # Minima put false before true, maxima true before false.
        return F.struct(c.isNotNull() if nulls_first or keep == "last" else c.isNull(), c)

    firsts = other.groupBy(*[named(k).alias(f"_k{i}") for i, k in enumerate(on)]).agg(pick(whole(other), order(named(other_id))).alias("_other"))
    met = joined_to_groups(mine.select(whole(mine).alias("_mine"), *map(named, on)), firsts, {k: f"_k{i}" for i, k in enumerate(on)}, "left" if outer else "inner", null_safe=False)
    ids = met.select("_mine", "_other", F.col("_mine").getField(my_id).alias("_my_id"), F.col("_other").getField(other_id).alias("_other_id"))
    best = ids.groupBy("_my_id").agg(pick(F.struct("_mine", "_other"), order(F.col("_other_id"))).alias("_best"))
    return best.select("_my_id", F.col("_best._mine").alias("_mine"), F.col("_best._other").alias("_other"), F.col("_best._other").getField(other_id).alias("_other_id"))


def _assembled(pairs: DataFrame, left_row: str, right_row: str, left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The columns of a join from the rows of both sides, either of which may be null."""
    cell = lambda row, c: F.col(row).getField(c)
    keys = [F.coalesce(cell(left_row, k), cell(right_row, k)).alias(k) for k in on]
    return pairs.select(*keys, *[cell(row, c).alias(c) for row, df in ((left_row, left), (right_row, right)) for c in df.columns if c not in on])


def _unrepeated(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, kind: str, keep: str) -> list[DataFrame]:
    """The parts of the join in which every id is the first (or last) of its own, by what is missing in them."""
    lefts = _first_matches(left, right, on, left_id, right_id, kind in ("left", "full"), keep).where("_my_id is not null")
    rights = _first_matches(right, left, on, right_id, left_id, kind in ("right", "full"), keep).where("_my_id is not null")
    seen = rights.select(F.col("_my_id").alias("_b"), F.col("_other_id").alias("_a"), F.lit(True).alias("_both"))
    kept = lefts.join(seen, (F.col("_my_id") == F.col("_a")) & (F.col("_other_id") == F.col("_b")), "left").where("_both or _other_id is null")
    return [_assembled(kept, "_mine", "_other", left, right, on), _assembled(rights.where("_other_id is null"), "_other", "_mine", left, right, on)]


def _met_once(mine: DataFrame, other: DataFrame, on: list[str], my_id: str, outer: bool) -> DataFrame:
    """The rows of ``mine`` whose id occurs once in the join; a missing id is no repeat."""
    counts = other.groupBy(*[named(k).alias(f"_k{i}") for i, k in enumerate(on)]).agg(F.count(F.lit(1)).alias("_n"))
    whole = F.struct(*map(named, mine.columns))
    met = joined_to_groups(mine.where(named(my_id).isNotNull()).select(whole.alias("_mine"), *map(named, on)), counts, {k: f"_k{i}" for i, k in enumerate(on)}, "left" if outer else "inner", null_safe=False)
    once = met.groupBy(F.col("_mine").getField(my_id)).agg(F.sum(F.coalesce("_n", F.lit(1))).alias("_n"), F.any_value("_mine").alias("_mine")).where("_n = 1").select("_mine.*")
    return once.unionByName(mine.where(named(my_id).isNull()))


# The joins that have the ids of both sides, by Spark's names without underscores.
_KINDS = {"inner": "inner", "cross": "inner", "left": "left", "leftouter": "left", "right": "right", "rightouter": "right", "outer": "full", "full": "full", "fullouter": "full"}


def join_and_keep_order(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, how: str = "inner", keep: str | None = None) -> DataFrame:
    """A join in the order of (left_id, right_id), the positions of the rows on either side.

    ``keep`` (first, last or none) removes rows whose id was seen before, after or at all elsewhere, on both
    sides; a missing id on the outer side of a join is no repeat. Then the join is not made of all pairs of a key.
    """
    joined = _sides(left, right, left_id, right_id, on).join(right, on, how)
    if keep:
        kind = _KINDS.get(how.lower().replace("_", ""))
        if kind is None:
            raise AmbiguousArgumentError(f"a join of kind {how} has no ids of both sides")
        if keep == "none":
            some_left, some_right = _met_once(left, right, on, left_id, kind in ("left", "full")), _met_once(right, left, on, right_id, kind in ("right", "full"))
            parts = [some_left.join(some_right, on)]
        else:
            some_left, some_right = left.where(named(left_id).isNull()), right.where(named(right_id).isNull())
            parts = [*_unrepeated(left, right, on, left_id, right_id, kind, "first" if keep == "first" else "last"), some_left.join(some_right, on)]
        # Of rows that meet none, those with an id are in the first parts already, unless they were counted.
        parts += [df.join(other.select(*map(named, on)), on, "left_anti") for df, other, sides in ((some_left, right, ("left", "full")), (some_right, left, ("right", "full"))) if kind in sides]
        kept = parts[0]
        for part in parts[1:]:
            kept = kept.unionByName(part, allowMissingColumns=True)
        joined = kept.select(*[named(f.name).cast(f.dataType).alias(f.name) for f in joined.schema.fields])
    return joined.orderBy(named(left_id).asc_nulls_last(), named(right_id).asc_nulls_last())


def join_wisely(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, remove_duplicates: bool = True) -> dict[str, DataFrame]:
    """both, left_only and right_only. Of repeated ids the first in (left, right) order stays in ``both``; rows
    that lose all their matches so count as unmatched."""
    both = _sides(left, right, left_id, right_id, on).join(right, on)
    if remove_duplicates:
        ids = lambda df, x: df.select(*map(named, dict.fromkeys([*on, x])))
        lefts = _first_matches(left, right, on, left_id, right_id, nulls_first=True)
        rights = _first_matches(ids(right, right_id), ids(left, left_id), on, right_id, left_id, nulls_first=True).select(F.col("_my_id").alias("_b"), F.col("_other_id").alias("_a"))
        kept = lefts.join(rights, F.col("_my_id").eqNullSafe(F.col("_a")) & F.col("_other_id").eqNullSafe(F.col("_b")), "left_semi")
        kept = _assembled(kept, "_mine", "_other", left, right, on)
        both = kept.select(*[named(f.name).cast(f.dataType).alias(f.name) for f in both.schema.fields])
        met_left, met_right = both.select(named(left_id)), both.select(named(right_id))
    else:
        # An id has a match if one of its rows has; the pairs are not needed.
        met_left = left.join(right.select(*map(named, on)), on, "left_semi").select(named(left_id))
        met_right = right.join(left.select(*map(named, on)), on, "left_semi").select(named(right_id))
    return {"both": both, "left_only": left.join(met_left, left_id, "left_anti"), "right_only": right.join(met_right, right_id, "left_anti")}


def fast_merge(left: DataFrame, right: DataFrame, left_on: str | list[str], right_on: str | list[str], how: str = "inner") -> DataFrame:
    """Join on differently named keys; both key columns get the joined value, other shared names _x and _y."""
    lk, rk = ([k] if isinstance(k, str) else list(k) for k in (left_on, right_on))
    shared = [c for c in left.columns if c in right.columns and c not in lk and c not in rk]
    l = left.select(*[F.col(c).alias(f"{c}_x" if c in shared else f"_l{lk.index(c)}" if c in lk else c) for c in left.columns])
    r = right.select(*[F.col(c).alias(f"{c}_y" if c in shared else f"_r{rk.index(c)}" if c in rk else c) for c in right.columns])
    condition = F.lit(True)
    for i in range(len(lk)):
        condition = condition & (l[f"_l{i}"] == r[f"_r{i}"])
    joined = l.join(r, condition, how)
    keys = {}
    for i, (a, b) in enumerate(zip(lk, rk)):
        value = F.coalesce(f"_l{i}", f"_r{i}")
        keys |= {a: value, b: value}
    rest = [c for c in l.columns + r.columns if not c.startswith(("_l", "_r"))]
    return joined.select(*[v.alias(k) for k, v in keys.items()], *rest)


def join_and_preserve_types(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", priority: str = "left") -> DataFrame:
    """Each column keeps its type; a shared one takes that of the side with priority, where its values fit."""
    first, second = (left, right) if priority == "left" else (right, left)
    kinds = {**dict(second.dtypes), **dict(first.dtypes)}
    joined = left.join(right, on, how)
    return joined.select(*[F.col(c) if dict(joined.dtypes)[c] == kinds[c] else F.col(c).try_cast(kinds[c]).alias(c) for c in joined.columns])
