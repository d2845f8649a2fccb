"""User functions over rows, groups and tasks.

``map_values`` and ``apply_rows`` run Python in Arrow batches, for what no Column expression says; ``run_tasks``
submits driver-side tasks, each of which may start Spark jobs, from a pool of threads.
"""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def map_values(function: Callable[[Any], Any], column: Column, returns: str) -> Column:
    """``function`` of each value, nulls included."""

    def batch(values: pd.Series) -> pd.Series:
        return pd.Series([function(None if pd.isna(x) else x) for x in values], dtype=object)

    return F.pandas_udf(batch, returns)(column)


def apply_rows(df: DataFrame, function: Callable[[dict[str, Any]], Any], name: str, returns: str) -> DataFrame:
    """Adds ``function`` of each row, given as a dictionary; batches stream, so any partition size will do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: [function(r) for r in batch.to_dict("records")]})

    return df.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in [*df.dtypes, (name, returns)]))


def evaluate_groups(df: DataFrame, by: list[str], actual: str, predicted: str, function: Callable[[pd.Series, pd.Series], dict[str, float]], names: list[str]) -> DataFrame:
    """A user's metric function of (actual, predicted) for each group; a group must fit into one task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = function(group[actual], group[predicted])
        return pd.DataFrame([{**{c: group[c].iloc[0] for c in by}, **{n: float(found[n]) for n in names}}])

    kinds = dict(df.dtypes)
    return df.select(*by, actual, predicted).groupBy(*by).applyInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), *(f"`{n}` double" for n in names)]))


@dataclass
class Outcome:
    """What became of a task: its result or its error, and when."""

    task: str
    started: float
    elapsed: float
    result: Any = None
    error: str | None = None


def run_tasks(tasks: dict[str, Callable[[], Any]], threads: int = 4) -> dict[str, Outcome]:
    """Runs all tasks; a failed one is an outcome with its error and stops no other."""

    def one(item: tuple[str, Callable[[], Any]]) -> Outcome:
        name, task = item
        start = time.time()
        try:
            result = task()
            return Outcome(name, start, time.time() - start, result)
        except Exception:  # noqa: BLE001  reported, not hidden
            return Outcome(name, start, time.time() - start, None, traceback.format_exc())

    with ThreadPoolExecutor(threads) as pool:
        return {o.task: o for o in pool.map(one, tasks.items())}


def outcomes_table(spark: SparkSession, outcomes: dict[str, Outcome]) -> DataFrame:
    return spark.createDataFrame([(o.task, o.started, o.elapsed, o.error) for o in outcomes.values()], "task string, started double, elapsed double, error string")
