"""Missing values: constants, statistics, one-predictor regression, and models chosen per column."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AmbiguousArgumentError, ImputationError, NoColumnsError, NotFittedError
from ..rows import is_missing, is_numeric, joined_to_groups, named, require_columns
from .quantiles import grouped_medians, quantiles
from .statistics import best_coverage, regression_metrics
from .wrangling import columns_with_missing, missing_counts


def impute_with_regression(df: DataFrame, based_on: str, columns: list[str], group_by: list[str] | None = None, limit_min: bool = True, limit_max: bool = True) -> DataFrame:
    """Fills each column from a line through (based_on, column), in each group, kept within the observed values.

    The line comes from built-in aggregates: one job, and the groups' lines join back to the rows. Where there
    is no line (too few points), the value stays missing.
    """
    require_columns(df, [based_on, *columns, *(group_by or [])])
    aggs = []
    for i, c in enumerate(columns):
        y, x = F.when(~is_missing(df, c), F.col(c)), F.when(~is_missing(df, based_on), F.col(based_on))
        aggs += [F.regr_slope(y, x).alias(f"_slope{i}"), F.regr_intercept(y, x).alias(f"_base{i}"), F.min(y).alias(f"_low{i}"), F.max(y).alias(f"_high{i}")]
    lines = df.groupBy(*(group_by or [])).agg(*aggs)
    if group_by:
        lines = lines.withColumnsRenamed({g: f"_key_{g}" for g in group_by})
        joined = joined_to_groups(df, lines, {g: f"_key_{g}" for g in group_by})
    else:
        joined = df.crossJoin(F.broadcast(lines))  # one row
    new = {}
    for i, c in enumerate(columns):
        guess = F.col(f"_base{i}") + F.col(f"_slope{i}") * F.col(based_on)
        if limit_min:
            guess = F.when(guess.isNotNull(), F.greatest(guess, F.col(f"_low{i}")))
        if limit_max:
            guess = F.when(guess.isNotNull(), F.least(guess, F.col(f"_high{i}")))
        new[c] = F.when(is_missing(df, c), guess).otherwise(F.col(c))
    return joined.withColumns(new).select(*df.columns)


@dataclass
class NaFillerFlagger:
    """Numeric columns with missing values: <c>_is_null, and the median or mean of the fitted table."""

    fill_with: str = "median"
    fills: dict[str, float] | None = None

    def fit(self, df: DataFrame, columns: list[str] | None = None) -> NaFillerFlagger:
        if self.fill_with not in ("median", "mean"):
            raise AmbiguousArgumentError("median or mean")
        chosen = columns or columns_with_missing(df, only_numeric=True)
        if self.fill_with == "median":
            self.fills = {c: v for c, (v,) in quantiles(df, {c: named(c) for c in chosen}, [0.5]).items()}
        else:
            row = df.agg(*[F.avg(F.when(~is_missing(df, c), named(c))).alias(f"c{i}") for i, c in enumerate(chosen)]).first() if chosen else ()
            self.fills = dict(zip(chosen, row))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.fills is None:
            raise NotFittedError("not fitted")
        new = {}
        for c, v in self.fills.items():
            new[f"{c}_is_null"] = is_missing(df, c).cast("int")
            new[c] = F.when(is_missing(df, c), F.lit(v)).otherwise(named(c))
        return df.withColumns(new)


def fill_na_and_flag(df: DataFrame, fill_with: str = "median") -> DataFrame:
    return NaFillerFlagger(fill_with).fit(df).transform(df)


def fill_each_split(df: DataFrame, columns: list[str], split: str, fill_with: str = "mean") -> DataFrame:
    """Fills each part of a split with its own statistic. A part without values keeps its gaps."""
    if fill_with == "median":
        stats = grouped_medians(df, split, columns)
    else:
        stats = df.groupBy(named(split).alias("_part")).agg(*[F.avg(F.when(~is_missing(df, c), named(c))).alias(f"_fill{i}") for i, c in enumerate(columns)])
    joined = joined_to_groups(df, stats, {split: "_part"}, "left")
    return joined.withColumns({c: F.when(is_missing(df, c), F.col(f"_fill{i}")).otherwise(named(c)) for i, c in enumerate(columns)}).select(*map(named, df.columns))


@dataclass
class ColumnImputer:
    """Fits an ML estimator on the rows where ``column`` is known and predicts the others.

    Helpers are numeric columns; missing helper values take the fitted medians. With several estimators the
    one of least ``metric`` on a seeded fifth of the known rows is chosen and fitted on all.
    """

    column: str
    helpers: list[str] | None = None
    estimators: list[Estimator] = field(default_factory=lambda: [LinearRegression()])
    metric: str = "rmse"
    key: str | None = None
    model: Model | None = None

    def _features(self, df: DataFrame) -> DataFrame:
        filled = df.withColumns({f"_x{i}": F.coalesce(F.when(~is_missing(df, c), F.col(c)).cast("double"), F.lit(self.fills[c])) for i, c in enumerate(self.used)})
        return VectorAssembler(inputCols=[f"_x{i}" for i in range(len(self.used))], outputCol="features").transform(filled)

    def fit(self, df: DataFrame) -> ColumnImputer:
        helpers = self.helpers or [c for c in best_coverage(df, self.column) or df.columns if is_numeric(df, c)]
        self.used = [c for c in helpers if c != self.column and is_numeric(df, c)]
        if not self.used:
            raise NoColumnsError(f"no columns to impute {self.column} from")
        known = df.where(~is_missing(df, self.column))
        medians = quantiles(known, {c: named(c) for c in self.used}, [0.5])
        if not known.limit(1).count():
            raise ImputationError(f"{self.column} is missing everywhere")
        self.fills = {c: v if v is not None else 0.0 for c, (v,) in medians.items()}
        self.indexer = None
        label = F.col(self.column).cast("double")
        ready = self._features(known)
        if not is_numeric(df, self.column):
            self.indexer = StringIndexer(inputCol=self.column, outputCol="_label").fit(known)
            ready = self.indexer.transform(ready)
        else:
            ready = ready.withColumn("_label", label)
        ready = ready.select("features", "_label", *([self.key] if self.key else [])).cache()
        best = self.estimators[0]
        if len(self.estimators) > 1:
            part = F.pmod(F.xxhash64(self.key or "_label"), F.lit(5)) == 0
            train, test = ready.where(~part), ready.where(part)

            def loss(e: Estimator) -> float:
                out = e.fit(train, {e.labelCol: "_label"}).transform(test)
                return regression_metrics(out, "_label", "prediction").first()[self.metric]

            with ThreadPoolExecutor(4) as pool:
                losses = list(pool.map(loss, self.estimators))
            best = self.estimators[losses.index(min(losses))]
        self.model = best.fit(ready, {best.labelCol: "_label"})
        ready.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise NotFittedError("not fitted")
        out = self.model.transform(self._features(df))
        guess = F.col("prediction")
        if self.indexer is not None:
            guess = F.element_at(F.array(*map(F.lit, self.indexer.labels)), guess.cast("int") + 1)
        return out.withColumn(self.column, F.when(is_missing(df, self.column), guess).otherwise(F.col(self.column))).select(*df.columns)


@dataclass
class DataImputer:
    """A ColumnImputer for each column with missing values, fitted concurrently.

    All predict from the values as they came (``sequential=False``), or each from what the ones before have
    filled.
    """

    ignore: tuple[str, ...] = ()
    impute: tuple[str, ...] | None = None
    categorical: bool = False
    sequential: bool = False
    regressors: list[Estimator] = field(default_factory=lambda: [LinearRegression()])
    classifiers: list[Estimator] = field(default_factory=list)

    def __post_init__(self):
        if set(self.ignore) & set(self.impute or ()):
            raise AmbiguousArgumentError("a column is to be imputed and ignored")

    def fit(self, df: DataFrame) -> DataImputer:
        usable = df.drop(*self.ignore)
        targets = [c for c, n in missing_counts(usable).items() if n and (self.impute is None or c in self.impute) and (self.categorical or is_numeric(df, c))]
        make = lambda c: ColumnImputer(c, estimators=self.regressors if is_numeric(df, c) else self.classifiers)
        with ThreadPoolExecutor(4) as pool:
            self.imputers = list(pool.map(lambda c: make(c).fit(usable), targets))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out, names = df, df.columns
        originals = {} if self.sequential else {i.column: f"_was_{i.column}" for i in self.imputers}
        out = out.withColumns({new: F.col(c) for c, new in originals.items()})
        filled = {}
        for imputer in self.imputers:
            if self.sequential:
                out = imputer.transform(out)
                continue
            done = imputer.transform(out.withColumns({c: F.col(w) for c, w in originals.items()}))
            out = done.withColumn(f"_new_{imputer.column}", F.col(imputer.column))
            filled[imputer.column] = f"_new_{imputer.column}"
        return out.withColumns({c: F.col(n) for c, n in filled.items()}).select(*names)
