"""How long a function takes, learnt from runs of it: a weighted linear model on polynomial features."""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFittedError
from ..functions.control import with_timeout
from ..sources.synthetic import _values
from .features import Polynomial
from .models import assembled


@dataclass
class RuntimeEstimator:
    """Measures ``function`` for chosen arguments and predicts its elapsed time and the chance of an error.

    Long runs weigh more, by the square of their time, since they are the ones worth predicting.
    """

    spark: SparkSession
    function: Callable[..., Any]
    timeout: float | None = 20.0
    degree: int = 2
    records: list[dict[str, float]] = field(default_factory=list)

    def measure(self, **arguments: float) -> float | None:
        """Seconds of one run, None if it failed; the same arguments are not run twice."""
        for r in self.records:
            if all(r[k] == float(v) for k, v in arguments.items()):
                return None if r["error"] else r["elapsed"]
        start, error = time.perf_counter(), 0.0
        try:
            with_timeout(self.spark, lambda: self.function(**arguments), self.timeout)
        except Exception:  # noqa: BLE001  an error is what is measured here
            error = 1.0
        elapsed = time.perf_counter() - start
        self.records.append({**{k: float(v) for k, v in arguments.items()}, "elapsed": elapsed, "error": error})
        return None if error else elapsed

    def explore(self, rounds: int, arguments: dict[str, Any], budget: float | None = None, seed: int = 42) -> None:
        """Measures a grid of arguments in seeded order until ``budget`` seconds are spent."""
        grid = [dict(zip(arguments, x)) for x in itertools.product(*(_values(v, rounds) for v in arguments.values()))]
        random.Random(seed).shuffle(grid)
        end = time.perf_counter() + (budget or float("inf"))
        for point in grid:
            if time.perf_counter() >= end:
                return
            self.measure(**point)

    def data(self) -> DataFrame:
        return self.spark.createDataFrame(self.records)

    def _x(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        names = sorted(c for c in self.records[0] if c not in ("elapsed", "error"))
        poly = Polynomial(self.degree, "_")
        return poly.transform(df, names), [*names, *(poly.name(m) for m in poly.monomials(names))]

    def fit(self) -> RuntimeEstimator:
        if not self.records:
            raise NotFittedError("nothing measured")
        rows, self.columns = self._x(self.data().withColumn("weight", F.col("elapsed") * F.col("elapsed") + 1e-12))
        good = assembled(rows.where("error = 0"), self.columns)
        self.model = LinearRegression(labelCol="elapsed", weightCol="weight", solver="normal", regParam=1e-9).fit(good)
        self.error_model = None
        if len({r["error"] for r in self.records}) > 1:
            self.error_model = RandomForestRegressor(labelCol="error", numTrees=20, seed=42).fit(assembled(rows, self.columns))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds estimated_seconds (never negative) and, if errors were seen, error_expected."""
        if not hasattr(self, "model"):
            raise NotFittedError("not fitted")
        rows, columns = self._x(df)
        ready = assembled(rows, columns)
        out = self.model.transform(ready).withColumn("estimated_seconds", F.greatest("prediction", F.lit(0.0))).drop("prediction")
        if self.error_model is not None:
            out = self.error_model.transform(out).withColumn("error_expected", F.col("prediction") >= 0.5).drop("prediction")
        return out.drop("features", *[c for c in columns if c not in df.columns])
