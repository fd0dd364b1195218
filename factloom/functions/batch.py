"""Arrow-batched functions that are made when they are first used, so that importing a module needs no Spark session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Rows of whole texts that a Python worker holds at a time.
TEXTS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Batches of ``TEXTS`` rows where Spark's default of 10,000 stands: whole texts and pages are long, and a worker holds a batch several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(TEXTS))


def batch_function(return_type: str) -> Callable[[Callable], Callable[..., Column]]:
    """Decorator: a function of pandas series as a function of columns."""

    def wrap(function: Callable) -> Callable[..., Column]:
        def call(*columns) -> Column:
            return F.pandas_udf(function, return_type)(*columns)

        call.__name__, call.__doc__ = function.__name__, function.__doc__
        return call

    return wrap


def arrow_function(return_type: str) -> Callable[[Callable], Callable[..., Column]]:
    """Decorator: a function of Arrow arrays as a function of columns."""

    def wrap(function: Callable) -> Callable[..., Column]:
        def call(*columns) -> Column:
            return F.arrow_udf(function, return_type)(*columns)

        call.__name__, call.__doc__ = function.__name__, function.__doc__
        return call

    return wrap
