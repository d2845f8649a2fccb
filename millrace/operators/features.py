"""Feature engineering: fit takes one aggregate job, transform adds plain columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AlreadyFittedError, DataError, NotFittedError
from ..rows import is_missing, named, require_columns


@dataclass
class Normalizer:
    """(x - mean) / sample standard deviation; a constant column is only centred."""

    ignore: tuple[str, ...] = ()
    stats: dict[str, tuple[float, float]] | None = None

    def fit(self, df: DataFrame, columns: list[str] | None = None) -> Normalizer:
        if self.stats is not None:
            raise AlreadyFittedError("fitted already")
        chosen = columns or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in self.ignore]
        row = df.agg(*[f(F.when(~is_missing(df, c), F.col(c))).alias(f"{n}{i}") for i, c in enumerate(chosen) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
        stats = {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(chosen)}
        if any(v is None for pair in stats.values() for v in pair):
            raise DataError("a column lacks a mean or a deviation")
        self.stats = stats
        return self

    def _fitted(self) -> dict[str, tuple[float, float]]:
        if self.stats is None:
            raise NotFittedError("not fitted")
        return self.stats

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s or 1.0) for c, (m, s) in self._fitted().items()})

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def untransform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(s or 1.0) + F.lit(m) for c, (m, s) in self._fitted().items()})

    def parameters(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame([(c, m, s) for c, (m, s) in self._fitted().items()], "column string, mean double, sd double")


@dataclass
class OneHotEncoder:
    """Dummies for the commonest values of each text column (count, then value); others and null are ``other``.

    Originals go. A dummy that would be the same in every row of the fitted table is left out.
    """

    top: int = 10
    other: str = "other"
    lowercase: bool = True
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    values: dict[str, list[str]] | None = field(default=None)

    def _value(self, c: str) -> Column:
        s = named(c).cast("string")
        return F.lower(s) if self.lowercase else s

    def fit(self, df: DataFrame) -> OneHotEncoder:
        chosen = [c for c in (self.include or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]) if c not in self.exclude]
        require_columns(df, chosen)
        self.values = {}
        if not chosen:
            return self
        # One job counts the values of all columns; each column's are cut to ``top`` before they meet.
        cells = F.array(*[F.struct(F.lit(i).alias("c"), self._value(c).alias("v")) for i, c in enumerate(chosen)])
        counts = df.select(F.explode(cells).alias("x")).groupBy("x.c", "x.v").count().where("v is not null")
        rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("count"), "v"))
        rows, total = counts.withColumn("_rank", rank).where(F.col("_rank") <= self.top).orderBy("c", "_rank").collect(), df.count()
        for i, c in enumerate(chosen):
            best = [r for r in rows if r["c"] == i]
            self.values[c] = [r["v"] for r in best if r["count"] < total]
            if 0 < sum(r["count"] for r in best) < total:
                self.values[c].append(self.other)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.values is None:
            raise NotFittedError("not fitted")
        new = {}
        for c, values in self.values.items():
            known = [v for v in values if v != self.other]
            v = self._value(c)
            for x in values:
                hit = ~F.coalesce(v.isin(known), F.lit(False)) if x == self.other else F.coalesce(v == x, F.lit(False))
                new[f"{c}_{x}"] = hit.cast("int")
        return df.withColumns(new).drop(*self.values)

    encode = transform

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


@dataclass(frozen=True)
class Polynomial:
    """Adds every monomial of degree 2 to ``degree``; names join the columns, exponents above 1 appended."""

    degree: int = 2
    sep: str = "."

    def monomials(self, columns: list[str]) -> list[tuple[str, ...]]:
        return [m for d in range(2, self.degree + 1) for m in combinations_with_replacement(sorted(columns), d)]

    def name(self, monomial: tuple[str, ...]) -> str:
        return self.sep.join(c + (str(monomial.count(c)) if monomial.count(c) > 1 else "") for c in sorted(set(monomial)))

    def transform(self, df: DataFrame, columns: list[str]) -> DataFrame:
        new = {}
        for m in self.monomials(columns):
            product = F.col(f"`{m[0]}`").cast("double")
            for c in m[1:]:
                product = product * F.col(f"`{c}`")
            new[self.name(m)] = product
        return df.withColumns(new)


def error_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """<c>_is_zero, _is_positive, _rounded (half-even) and _is_int."""
    new = {}
    for c in columns:
        x = F.col(c)
        new |= {f"{c}_is_zero": x == 0, f"{c}_is_positive": x > 0, f"{c}_rounded": F.bround(x), f"{c}_is_int": x == F.bround(x)}
    return df.withColumns(new)
