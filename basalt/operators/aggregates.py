"""Grouped and global aggregation from plain descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS = {
    "count": F.count,
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count_distinct": F.countDistinct,
    "try_sum": F.try_sum,
    "stddev": F.stddev_samp,
    "variance": F.var_samp,
    "median": F.median,
}


def money(column: str | Column) -> Column:
    """A sum that does not depend on the order of addition: of exact decimals, as double."""
    column = F.col(column) if isinstance(column, str) else column
    return F.sum(column.cast("decimal(18,2)")).cast("double")


def aggregate(df: DataFrame, keys: list[str | Column], aggs: list[tuple[str, str, str]], where: Column | None = None, having: Column | None = None) -> DataFrame:
    """WHERE, GROUP BY, aggregates (function, column or "*", alias) and HAVING, in that order; partial sums before the shuffle."""
    df = df.where(where) if where is not None else df
    made = [FUNCTIONS[fn]("*" if c == "*" else F.col(c)).alias(alias) for fn, c, alias in aggs]
    out = df.groupBy(*keys).agg(*made) if keys else df.agg(*made)
    return out.where(having) if having is not None else out
