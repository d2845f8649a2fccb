"""A thin front: data sets, estimators, one search for each, one table of scores."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Estimator
from pyspark.sql import DataFrame

from ..errors import DuplicationError, EmptyError
from .sampling import Validation
from .search import CrossValidationSearch, EstimatorRepository


@dataclass
class AutoML:
    problem: str = "regression"
    metric: str | None = None
    threads: int = 4
    searches: dict[str, CrossValidationSearch] = field(default_factory=dict)
    repository: EstimatorRepository = field(default_factory=EstimatorRepository)
    _data: dict[str, tuple] = field(default_factory=dict)

    def add_models(self, cls: type[Estimator], grid: dict[str, Any] | None = None) -> AutoML:
        self.repository.append(cls, grid)
        return self

    def add_validation(self, name: str, df: DataFrame, x_columns: list[str], y_column: str, validation: Validation) -> AutoML:
        if name in self._data:
            raise DuplicationError(f"{name} is there already")
        self._data[name] = (df, x_columns, y_column, validation)
        return self

    def run(self, budget: int | None = None) -> AutoML:
        """``budget``: fits for each data set; all if None."""
        if not self._data:
            raise EmptyError("no data")
        for name, (df, x, y, validation) in self._data.items():
            if name not in self.searches:
                self.searches[name] = CrossValidationSearch(df, x, y, self.repository, validation, self.problem, self.metric, self.threads)
            self.searches[name].run(budget)
        return self

    def best(self) -> dict[str, str]:
        return {name: s.best_estimator() for name, s in self.searches.items()}
