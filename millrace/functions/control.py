"""Time limits and timing of Spark jobs, on the driver."""

from __future__ import annotations

import ctypes
import inspect
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from ..errors import JobTimeoutError


def with_timeout(spark: SparkSession, function: Callable[[], Any], seconds: float | None) -> Any:
    """Runs ``function``, in a thread of its own if there is a limit, and returns or raises what it does.

    After ``seconds`` its Spark jobs are cancelled, JobTimeoutError is raised here at once, and in its thread at the
    next step of Python, so that loops end too; a call outside Python that cannot be interrupted ends in the background.
    """
    if seconds is None:
        return function()
    tag, done = f"limit-{uuid.uuid4().hex}", {}

    def run() -> None:
        spark.addTag(tag)
        try:
            done["value"] = function()
        except BaseException as e:
            done["error"] = e

    thread = InheritableThread(run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.interruptTag(tag)
        ctypes.pythonapi.PyThreadState_SetAsyncExc(ctypes.c_ulong(thread.ident), ctypes.py_object(JobTimeoutError))
        raise JobTimeoutError(f"more than {seconds} s")
    if "error" in done:
        raise done["error"]
    return done["value"]


def function_arguments(function: Callable) -> list[str]:
    return list(inspect.signature(function).parameters)


@dataclass
class Measurements:
    """Named stretches of time; ``summary`` in Spark."""

    records: list[tuple[str, float]] = field(default_factory=list)

    @contextmanager
    def measure(self, name: str):
        start = time.perf_counter()
        try:
            yield
        finally:
            self.records.append((name, time.perf_counter() - start))

    def data(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.records, "name string, seconds double")

    def summary(self, spark: SparkSession) -> DataFrame:
        from pyspark.sql import functions as F

        return self.data(spark).groupBy("name").agg(F.count("*").alias("count"), F.sum("seconds").alias("total_seconds"), F.avg("seconds").alias("mean_seconds"))
