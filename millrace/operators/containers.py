"""Splits as objects: a training/test pair, and folds with an optional holdout, that fit and evaluate."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MissingRowsError, NotFittedError
from .models import assembled
from .sampling import Validation
from .search import train_and_test
from .statistics import aggregate_folds, classification_metrics, regression_metrics


@dataclass
class TrainingTestContainer:
    """One table with a column that says training or test; both parts are filters of it."""

    data: DataFrame
    x_columns: Sequence[str]
    y_column: str
    split: str = "split"

    def __post_init__(self):
        self.model = None

    @property
    def training_data(self) -> DataFrame:
        return self.data.where(F.col(self.split) == "training")

    @property
    def test_data(self) -> DataFrame:
        return self.data.where(F.col(self.split) == "test")

    def fit(self, estimator: Estimator) -> TrainingTestContainer:
        rows = self.training_data.where(F.col(self.y_column).isNotNull())
        self.model = estimator.fit(assembled(rows, self.x_columns), {estimator.labelCol: self.y_column})
        return self

    def predictions(self) -> DataFrame:
        if self.model is None:
            raise NotFittedError("not fitted")
        return self.model.transform(assembled(self.test_data, self.x_columns))

    def evaluate_regression(self) -> DataFrame:
        return regression_metrics(self.predictions(), self.y_column, "prediction")

    def evaluate_classification(self, negative=0, positive=1) -> DataFrame:
        return classification_metrics(self.predictions(), self.y_column, "prediction", negative, positive)


class ValidationContainer:
    """Folds (numbered from 1) and holdout of one cached table; estimators are fitted from driver threads."""

    def __init__(self, df: DataFrame, validation: Validation, x_columns: Sequence[str], y_column: str):
        self.spec, self.x_columns, self.y_column = validation, list(x_columns), y_column
        self.split = validation.split(df).cache()
        self.folds = list(validation.folds(self.split))

    @property
    def validation(self) -> DataFrame:
        return self.split.where("not is_holdout")

    @property
    def holdout(self) -> DataFrame:
        return self.split.where("is_holdout")

    @property
    def num_folds(self) -> int:
        return len(self.folds)

    def get_fold(self, k: int) -> tuple[DataFrame, DataFrame]:
        if not 1 <= k <= len(self.folds):
            raise MissingRowsError(f"no fold {k}")
        return self.folds[k - 1]

    def _evaluate(self, estimators: dict[str, Estimator], problem: str, aggregate: bool, threads: int) -> DataFrame:
        def one(job: tuple[str, int]) -> dict:
            name, k = job
            found = train_and_test(estimators[name].copy(), *self.get_fold(k), self.x_columns, self.y_column, problem)
            return {"estimator": name, "fold": k, **found}

        with ThreadPoolExecutor(threads) as pool:
            rows = list(pool.map(one, [(e, k) for e in estimators for k in range(1, self.num_folds + 1)]))
        out = self.split.sparkSession.createDataFrame(rows)
        if not aggregate:
            return out
        return aggregate_folds(out, ["estimator"], [c for c in rows[0] if c not in ("estimator", "fold")])

    def evaluate_regression(self, estimators: dict[str, Estimator], aggregate: bool = False, threads: int = 4) -> DataFrame:
        return self._evaluate(estimators, "regression", aggregate, threads)

    def evaluate_classification(self, estimators: dict[str, Estimator], aggregate: bool = False, threads: int = 4) -> DataFrame:
        return self._evaluate(estimators, "classification", aggregate, threads)
