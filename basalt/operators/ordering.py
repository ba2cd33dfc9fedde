"""Order, limits and top-k with PostgreSQL's order of NULLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pg_order(column: str, desc: bool = False) -> Column:
    """NULLs last ascending, first descending."""
    return F.col(column).desc_nulls_first() if desc else F.col(column).asc_nulls_last()


def top_k(df: DataFrame, order: list[Column], k: int, skip: int = 0) -> DataFrame:
    """The first k rows after ``skip``: each partition keeps its first rows only, before the one merge."""
    return df.orderBy(*order).offset(skip).limit(k) if skip else df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark prunes each partition's groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rn", rank.cast("long")).where(F.col("rn") <= k)
