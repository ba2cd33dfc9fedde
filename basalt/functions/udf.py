"""User functions: Arrow-batched scalar and aggregate functions and table functions, registered for SQL by name.

Built-in functions are faster; these are for what they cannot say.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register_scalar(spark: SparkSession, name: str, body: Callable[..., pd.Series], kind: str) -> None:
    """``body`` maps whole batches of columns to one."""

    def run(*columns: pd.Series) -> pd.Series:
        return body(*columns)

    run.__annotations__ = {}
    spark.udf.register(name, F.pandas_udf(run, kind, F.PandasUDFType.SCALAR))


def register_aggregate(spark: SparkSession, name: str, body: Callable[..., float], kind: str) -> None:
    """``body`` maps a group's columns to one value; a group must fit in memory."""

    def run(*columns: pd.Series):
        return body(*columns)

    run.__annotations__ = {}
    spark.udf.register(name, F.pandas_udf(run, kind, F.PandasUDFType.GROUPED_AGG))


def register_table(spark: SparkSession, name: str, handler: type, schema: str) -> None:
    """``handler.eval`` yields rows for each call."""
    spark.udtf.register(name, F.udtf(handler, returnType=schema))
