"""Model search: a registry of estimators, folds as filters, concurrent fits, a scoreboard.

Rows never leave Spark: a fold is a filter on one cached table, and each (estimator, fold) pair is an ML fit
that a driver thread submits. The scoreboard holds one number for each pair.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import AmbiguousArgumentError, ComparisonError, DuplicationError, EmptyError, EvaluationError, NotEvaluatedError
from ..functions.arrays import create_grid
from ..rows import is_missing
from .models import assembled
from .sampling import Validation
from .statistics import classification_metrics, regression_metrics

LOWER_IS_BETTER = {"nmae", "rmse", "mae", "mape", "smape"}


class EstimatorRepository:
    """Estimators of parameter grids, named <Class>_<n>; the same class and parameters enter once."""

    def __init__(self):
        self.estimators: dict[str, Estimator] = {}
        self._seen: set[str] = set()

    def append(self, cls: type[Estimator], grid: dict[str, Any] | None = None) -> None:
        for parameters in create_grid(grid or {}):
            key = hashlib.sha256(repr((cls.__name__, sorted(parameters.items(), key=str))).encode()).hexdigest()
            if key not in self._seen:
                self._seen.add(key)
                n = sum(k.rpartition("_")[0] == cls.__name__ for k in self.estimators) + 1
                self.estimators[f"{cls.__name__}_{n}"] = cls(**parameters)

    def __contains__(self, name: str) -> bool:
        return name in self.estimators

    def __len__(self) -> int:
        return len(self.estimators)


@dataclass(order=False)
class Evaluation:
    """One metric of one model; ``>`` means better, whichever way the metric points."""

    metric: str
    value: float | None = None

    def _worth(self, other: Evaluation) -> tuple[float, float]:
        if self.metric != other.metric:
            raise ComparisonError("different metrics")
        if self.value is None or other.value is None:
            raise NotEvaluatedError("not evaluated")
        sign = -1 if self.metric in LOWER_IS_BETTER else 1
        return sign * self.value, sign * other.value

    def __gt__(self, other: Evaluation) -> bool:
        a, b = self._worth(other)
        return a > b

    def __lt__(self, other: Evaluation) -> bool:
        a, b = self._worth(other)
        return a < b


class Scoreboard:
    """Scores by (estimator, data); what is not measured yet counts as the best possible score, an optimistic
    bound, in the order in which to try estimators."""

    def __init__(self, lowest_is_best: bool = True, best_score: float | None = None):
        if best_score is None:
            best_score = 0.0 if lowest_is_best else 1.0
        if not lowest_is_best and best_score == 0:
            raise AmbiguousArgumentError("0 cannot be the best of scores that rise")
        self.lowest_is_best, self.best_score = lowest_is_best, best_score
        self.scores: dict[tuple[str, str], float | None] = {}

    def add_task(self, estimator: str, data: str) -> None:
        if (estimator, data) in self.scores:
            raise DuplicationError("task is there already")
        self.scores[estimator, data] = None

    def add_score(self, estimator: str, data: str, score: float) -> None:
        if self.scores.get((estimator, data)) is not None:
            raise DuplicationError("score is there already")
        self.scores[estimator, data] = score

    def data(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(e, d, s) for (e, d), s in self.scores.items()], "estimator string, data string, score double")

    def best_estimators(self, spark: SparkSession, n: int = 1) -> list[str]:
        ranked = measured(self.data(spark))
        order = F.col("mean").asc() if self.lowest_is_best else F.col("mean").desc()
        found = [r["estimator"] for r in ranked.orderBy(order, "estimator").limit(n).collect()]
        if not found:
            raise NotEvaluatedError("no scores yet")
        return found


def measured(scores: DataFrame) -> DataFrame:
    """count, mean, min, max and sample deviation of each estimator's scores."""
    return scores.where("score is not null").groupBy("estimator").agg(F.count("score").alias("count"), F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"), F.stddev_samp("score").alias("std"))


def mean_per(scores: DataFrame, by: str) -> DataFrame:
    return scores.groupBy(by).agg(F.avg("score").alias("mean"))


def upper_bounds(scores: DataFrame, best_score: float) -> DataFrame:
    """Mean of each estimator over all data, unmeasured pairs counted as ``best_score``."""
    grid = scores.select("estimator").distinct().crossJoin(scores.select("data").distinct())  # estimators x folds
    full = grid.join(scores.groupBy("estimator", "data").agg(F.avg("score").alias("score")), ["estimator", "data"], "left")
    return full.groupBy("estimator").agg(F.avg(F.coalesce("score", F.lit(best_score))).alias("best_possible"), F.count("score").alias("count_measured"))


def task_order(scores: DataFrame, best_score: float, lowest_is_best: bool = True, seed: int = 42) -> DataFrame:
    """Unmeasured (estimator, data) pairs in the order to do them: each estimator's first pair before any's
    second; then the best possible mean; then the data with the worst mean; then seeded."""
    worst = scores.groupBy("data").agg(F.avg("score").alias("_data_mean"))
    open_ = scores.where("score is null").join(upper_bounds(scores, best_score), "estimator").join(worst, "data")
    harder = F.col("_data_mean").desc_nulls_first() if lowest_is_best else F.col("_data_mean").asc_nulls_first()
    digest = F.md5(F.concat_ws("-", F.lit(seed), "estimator", "data"))
    turn = F.row_number().over(Window.partitionBy("estimator").orderBy(harder, digest)) - 1
    better = F.asc("best_possible") if lowest_is_best else F.desc("best_possible")
    return open_.withColumn("turn", turn).orderBy("turn", better, harder, digest).drop("_data_mean")


def train_and_test(estimator: Estimator, training: DataFrame, test: DataFrame, x_columns: list[str], y_column: str, problem: str = "regression", sort_columns: list[str] | None = None) -> dict[str, Any]:
    """Fits on rows with a known y, evaluates on such rows; sizes, metrics and the range of the sort columns."""
    train, held = (d.where(~is_missing(d, y_column)) for d in (training, test))
    model = estimator.fit(assembled(train, x_columns), {estimator.labelCol: y_column})
    predicted = model.transform(assembled(held, x_columns))
    if problem == "regression":
        metrics = regression_metrics(predicted, y_column, "prediction")
    else:
        metrics = classification_metrics(predicted, y_column, "prediction", 0, 1)
    out = {"training_size": train.count(), "test_size": held.count(), **metrics.first().asDict()}
    for c in sort_columns or []:
        out[f"{c}_from"], out[f"{c}_to"] = held.agg(F.min(c), F.max(c)).first()
    return out


@dataclass
class CrossValidationSearch:
    """Every estimator on every fold, or ``budget`` pairs by optimistic order; best estimator, holdout result and
    final model. A failed fit is a row with its error; it does not stop the others."""

    df: DataFrame
    x_columns: list[str]
    y_column: str
    repository: EstimatorRepository
    validation: Validation
    problem: str = "regression"
    metric: str | None = None
    threads: int = 4
    choose: str = "upper_bound"
    evaluate: Callable[[DataFrame], float] | None = None
    results: list[dict[str, Any]] = field(default_factory=list)

    def __post_init__(self):
        if not len(self.repository):
            raise EmptyError("no estimators")
        self.metric = self.metric or ("smape" if self.problem == "regression" else "f1_score")
        self.split = self.validation.split(self.df).cache()
        self.board = Scoreboard(self.metric in LOWER_IS_BETTER)
        self.folds = dict(enumerate(self.validation.folds(self.split), 1))
        for e in self.repository.estimators:
            for k in self.folds:
                self.board.add_task(e, f"fold_{k}")

    def _do(self, pair: tuple[str, str]) -> None:
        name, data = pair
        train, test = self.folds[int(data[5:])]
        try:
            found = train_and_test(self.repository.estimators[name].copy(), train, test, self.x_columns, self.y_column, self.problem)
            self.results.append({"estimator": name, "data": data, **found})
            self.board.add_score(name, data, found[self.metric])
        except Exception as e:  # noqa: BLE001  the fit's own failure is its result
            self.results.append({"estimator": name, "data": data, "error": str(e).splitlines()[0]})

    def run(self, budget: int | None = None) -> CrossValidationSearch:
        spark = self.df.sparkSession
        if budget is None:
            todo = [k for k, v in self.board.scores.items() if v is None]
        elif self.choose == "random":
            todo = random.Random(self.validation.seed).sample(sorted(k for k, v in self.board.scores.items() if v is None), budget)
        else:
            todo = [(r["estimator"], r["data"]) for r in task_order(self.board.data(spark), self.board.best_score, self.board.lowest_is_best).limit(budget).collect()]
        with ThreadPoolExecutor(self.threads) as pool:
            list(pool.map(self._do, todo))
        return self

    def best_estimator(self) -> str:
        return self.board.best_estimators(self.df.sparkSession)[0]

    def holdout_result(self) -> dict[str, Any]:
        held, rest = self.split.where("is_holdout"), self.split.where("not is_holdout")
        if not held.limit(1).count():
            raise EvaluationError("no holdout rows")
        return train_and_test(self.repository.estimators[self.best_estimator()].copy(), rest, held, self.x_columns, self.y_column, self.problem)

    def complete_model(self):
        e = self.repository.estimators[self.best_estimator()].copy()
        rows = self.df.where(~is_missing(self.df, self.y_column))
        return e.fit(assembled(rows, self.x_columns), {e.labelCol: self.y_column})
