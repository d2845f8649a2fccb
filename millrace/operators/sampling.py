"""Sampling and splitting, reproducible by a seeded digest of a key instead of a random state.

Ordering is done on the table of ids and comes back by a join; rows of an id never part. Ids are numbered and
summed in ranges, so their number may grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AmbiguousArgumentError, DataError, MissingArgumentError
from ..rows import first_rows, joined_to_groups, named, require_batch, require_columns, seeded_order, with_rank, with_row_id, with_running_total


def shuffle(df: DataFrame, key: str, seed: int = 42, name: str | None = None) -> DataFrame:
    """Rows in seeded order of their unique key; ``name`` adds the new position."""
    if name is None:
        return df.orderBy(seeded_order(key, seed), key)
    return with_row_id(df, [seeded_order(key, seed), F.col(key)], name)


def sample_per_group(df: DataFrame, group_by: list[str], key: str, ratio: float | None = None, n: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training, test): of each group round(size * ratio) rows, half-even, or at most n; test has all the rest."""
    if (ratio is None) == (n is None):
        raise AmbiguousArgumentError("give a ratio or a number")
    ranked = with_rank(df, group_by, [seeded_order(key, seed), F.col(key)], "_rank")
    take = F.lit(n) if ratio is None else F.bround(F.col("_size") * ratio)
    if ratio is not None:
        sizes = df.groupBy(*[named(g).alias(f"_s{i}") for i, g in enumerate(group_by)]).agg(F.count(F.lit(1)).alias("_size"))
        ranked = joined_to_groups(ranked, sizes, {g: f"_s{i}" for i, g in enumerate(group_by)}).drop(*[f"_s{i}" for i in range(len(group_by))])
    chosen = F.col("_rank") <= take
    return ranked.where(chosen).drop("_rank", "_size"), ranked.where(~chosen).drop("_rank", "_size")


def _count_of(total: int, n: int | None, fraction: float | None) -> int:
    if (n is None) == (fraction is None):
        raise AmbiguousArgumentError("give a number or a fraction")
    return max(0, min(total, round(total * fraction) if n is None else n))


def _ids(df: DataFrame, id_column: str) -> DataFrame:
    require_columns(df, [id_column])
    require_batch(df)
    return df.select(id_column).where(F.col(id_column).isNotNull()).distinct()


def sample_by_id(df: DataFrame, id_column: str, n: int | None = None, fraction: float | None = None, replace: bool = False, seed: int = 42) -> DataFrame:
    """All rows of ids sampled by seeded order; with ``replace`` an id may come several times, and its rows too."""
    ids = _ids(df, id_column)
    if not replace:
        k = _count_of(ids.count(), n, fraction)
        return df.join(first_rows(ids, [seeded_order(id_column, seed), F.col(id_column)], k), id_column, "left_semi")
    numbered = with_row_id(ids, [F.col(id_column)], "_n")
    total = numbered.count()
    k = round(total * fraction) if n is None else n
    draws = df.sparkSession.range(k).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))).alias("_n"))
    return df.join(draws.join(numbered, "_n").drop("_n"), id_column)


def split_by_id(df: DataFrame, id_column: str, n: int | None = None, fraction: float | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training, test): all rows of n ids, and all others. Rows without an id are in test."""
    ids = _ids(df, id_column)
    chosen = first_rows(ids, [seeded_order(id_column, seed), F.col(id_column)], _count_of(ids.count(), n, fraction))
    return df.join(chosen, id_column, "left_semi"), df.join(chosen, id_column, "left_anti")


def split_pieces(df: DataFrame, order_by: list[str], split_size: int | None = None, num_splits: int | None = None) -> DataFrame:
    """Adds piece 0, 1, ... to contiguous pieces [round(i * size), round((i + 1) * size)), half-even rounding."""
    if (split_size is None) == (num_splits is None):
        raise AmbiguousArgumentError("give a size or a number of pieces")
    numbered = with_row_id(df, [F.col(c) for c in order_by], "_at")
    total = numbered.count()
    size = float(split_size) if num_splits is None else total / num_splits
    pieces = num_splits if num_splits is not None else -(-total // split_size)
    guess = F.least(F.floor((F.col("_at") + 0.5) / size), F.lit(max(pieces - 1, 0))).cast("int")
    # Rounding moves a boundary by half a row at most, so the piece is the guess or a neighbour.
    start = lambda i: F.bround(i * F.lit(size))
    piece = F.when(F.col("_at") < start(guess), guess - 1).when(F.col("_at") >= start(guess + 1), F.least(guess + 1, F.lit(max(pieces - 1, 0)))).otherwise(guess)
    return numbered.withColumn("piece", piece.cast("int")).drop("_at")


def balance_sample(df: DataFrame, columns: list[str], key: str, n: int | None = None, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """n rows, groups as even as can be: the first of every group in seeded order, then the second, and so on.

    Only as many rows of a group are ranked as can be taken, which Spark prunes before the shuffle.
    """
    if fraction is not None and fraction > 1:
        raise AmbiguousArgumentError("fraction lies between 0 and 1")
    total = df.count()
    k = round(total * fraction) if n is None else n
    if k > total:
        raise AmbiguousArgumentError("more rows asked for than there are")
    rank = F.row_number().over(Window.partitionBy(*columns).orderBy(seeded_order(key, seed), key))
    ranked = df.withColumn("_rank", rank).where(F.col("_rank") <= k)
    return first_rows(ranked, [F.col("_rank"), *[F.col(c).asc_nulls_first() for c in columns]], k).drop("_rank")


@dataclass
class UpSampler:
    """Repeats each class to the size of the largest, or at most ``max_repeats`` times."""

    max_repeats: float | None = None
    fill_na: str | None = None

    def fit(self, df: DataFrame, label: str) -> UpSampler:
        self.label = label
        counts = df.groupBy(self._value(label)).count()
        largest = counts.agg(F.max("count")).first()[0] or 0
        repeats = F.lit(float(largest)) / F.col("count")
        if self.max_repeats:
            repeats = F.least(repeats, F.lit(float(self.max_repeats)))
        self.targets = counts.select("_label", repeats.alias("_repeats"), F.bround(repeats * F.col("count")).cast("long").alias("_want"))
        return self

    def _value(self, label: str) -> Column:
        c = F.col(label)
        return (c if self.fill_na is None else F.coalesce(c, F.lit(self.fill_na))).alias("_label")

    def upsample(self, df: DataFrame, key: str) -> DataFrame:
        labelled = df.select("*", self._value(self.label))
        targets = self.targets.withColumnRenamed("_label", "_target")
        joined = joined_to_groups(labelled, targets, {"_label": "_target"})
        copies = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.ceil("_repeats").cast("int"))))
        kept = with_rank(copies, ["_label"], [F.col("_copy"), F.col(key)], "_rank").where("_rank <= _want")
        return kept.withColumn(self.label, F.col("_label")).drop("_label", "_target", "_repeats", "_want", "_copy", "_rank")

    def fit_upsample(self, df: DataFrame, label: str, key: str) -> DataFrame:
        return self.fit(df, label).upsample(df, key)


def _bounds(total: int, ratios: Sequence[float] | None, counts: Sequence[int] | None) -> list[int]:
    """Cumulative counts at which buckets end."""
    if (ratios is None) == (counts is None):
        raise AmbiguousArgumentError("give ratios or counts")
    if ratios is not None:
        if round(sum(ratios), 5) != 1:
            raise DataError("ratios add up to 1")
        out, at = [], 0.0
        for r in ratios:
            at += r
            out.append(round(at * total))
        return out
    if sum(counts) != total:
        raise DataError("counts add up to the rows")
    return [sum(counts[: i + 1]) for i in range(len(counts))]


def split_counts(counts: DataFrame, count: str, order: list[Column], ratios: Sequence[float] | None = None, sizes: Sequence[int] | None = None) -> DataFrame:
    """Adds bucket 0, 1, ... to a table of ids with counts: an id lies where its cumulative count does, so one
    that straddles a boundary goes to the later bucket."""
    total = counts.agg(F.sum(count)).first()[0] or 0
    bucket = F.lit(0)
    bounds = _bounds(int(total), ratios, sizes)
    for b in bounds[:-1]:
        bucket = bucket + F.when(F.col("_running") > b, 1).otherwise(0)
    return with_running_total(counts, order, count, "_running").withColumn("bucket", bucket.cast("int")).drop("_running")


@dataclass(frozen=True)
class Validation:
    """How to split; ``split`` adds is_holdout and fold columns to a table.

    ids are ``id_columns``, else ``sort_columns`` (then time decides, not the seed), else the unique ``key``.
    ``num_splits`` 0: no folds. 1: one training/test split by ``test_ratio``; fold 1 marks its test rows, 0 its
    training rows. More: fold 1..k marks the rows that fold k tests on; for a time series the first block is 0
    and only trains, so that fold i trains on blocks below i. Holdout rows have no fold.
    """

    num_splits: int = 5
    holdout_ratio: float = 0.0
    test_ratio: float | None = None
    id_columns: tuple[str, ...] = ()
    sort_columns: tuple[str, ...] = ()
    key: str | None = None
    min_training_ratio: float = 0.0
    seed: int = 42

    def __post_init__(self):
        if self.id_columns and self.sort_columns:
            raise AmbiguousArgumentError("ids or a time order, not both")
        if not (self.id_columns or self.sort_columns or self.key):
            raise MissingArgumentError("id_columns, sort_columns or a key")
        if self.num_splits == 1 and self.test_ratio is None:
            raise MissingArgumentError("test_ratio")

    def folds_of_ids(self, df: DataFrame) -> DataFrame:
        ids = list(self.id_columns or self.sort_columns or (self.key,))
        require_columns(df, ids)
        require_batch(df)
        counts = df.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n"))
        digest = seeded_order(F.concat_ws("-", *[F.col(c).cast("string") for c in ids]), self.seed)
        order = [F.col(c) for c in ids] if self.sort_columns else [digest, *[F.col(c) for c in ids]]
        parts = [1 - self.holdout_ratio, self.holdout_ratio]
        held = split_counts(counts, "_n", order, ratios=parts).withColumnRenamed("bucket", "_held")
        kept = held.where("_held = 0")
        if self.num_splits == 0:
            folded = kept.withColumn("bucket", F.lit(None).cast("int"))
        elif self.num_splits == 1:
            folded = split_counts(kept, "_n", order, ratios=[1 - self.test_ratio, self.test_ratio])
        elif self.sort_columns:
            first = max(self.min_training_ratio, 1 / (self.num_splits + 1))
            rest = (1 - first) / self.num_splits
            folded = split_counts(kept, "_n", order, ratios=[first] + [rest] * self.num_splits)
        else:
            folded = split_counts(kept, "_n", order, ratios=[1 / self.num_splits] * self.num_splits).withColumn("bucket", F.col("bucket") + 1)
        tail = held.where("_held = 1").withColumn("bucket", F.lit(None).cast("int"))
        return folded.unionByName(tail).select(*ids, (F.col("_held") == 1).alias("is_holdout"), F.col("bucket").alias("fold"))

    def split(self, df: DataFrame) -> DataFrame:
        ids = list(self.id_columns or self.sort_columns or (self.key,))
        found = self.folds_of_ids(df)
        right = found.toDF(*[f"_{c}" for c in ids], "is_holdout", "fold")
        condition = F.lit(True)
        for c in ids:
            condition = condition & df[c].eqNullSafe(right[f"_{c}"])
        return df.join(right, condition).drop(*[f"_{c}" for c in ids])

    def folds(self, split: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
        """(training, test) of each fold of a table that ``split`` made."""
        rows = split.where(~F.col("is_holdout"))
        for k in range(1, self.num_splits + 1):
            train = F.col("fold") < k if self.sort_columns or self.num_splits == 1 else F.col("fold") != k
            yield rows.where(train), rows.where(F.col("fold") == k)


def training_test(df: DataFrame, test_ratio: float, key: str | None = None, id_columns: tuple[str, ...] = (), sort_columns: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """Adds split: training or test."""
    spec = Validation(1, 0.0, test_ratio, id_columns, sort_columns, key, seed=seed)
    return spec.split(df).withColumn("split", F.when(F.col("fold") == 1, "test").otherwise("training")).drop("fold", "is_holdout")
