"""Column profiles, encoding advice and layout advice, from single aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def column_profile(df: DataFrame, column: str, order: list[str], within: list[str]) -> DataFrame:
    """n, n_distinct, n_runs, min_delta and max_delta of a numeric column, read in ``order``.

    Runs are counted inside the groups of ``within``, so that no order over the whole table is needed.
    """
    if not within:
        raise ValueError("within names the groups that are read in order")
    w = Window.partitionBy(*within).orderBy(*order)
    before = F.lag(column).over(w)
    rows = df.select(F.col(column).alias("v"), before.alias("p"), F.row_number().over(w).alias("k"))
    return rows.agg(
        F.count("*").alias("n"),
        F.countDistinct("v").alias("n_distinct"),
        F.sum(F.when((F.col("k") == 1) | ~F.col("v").eqNullSafe(F.col("p")), 1).otherwise(0)).alias("n_runs"),
        F.min(F.col("v") - F.col("p")).alias("min_delta"),
        F.max(F.col("v") - F.col("p")).alias("max_delta"),
    )


def codec_advice(kind: str, n: int, n_distinct: int, constant_delta: bool, n_runs: int | None = None) -> str:
    """The encoding that suits a column: delta, runs or packed bits for integers, a dictionary or general compression for text."""
    if kind in ("int", "bigint"):
        if constant_delta:
            return "delta"
        return "rle" if n_runs is None or n_runs <= 0.5 * n else "bitpack"
    return "dictionary" if n and n_distinct < 0.1 * n else "gzip"


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin (from 0), n, low and high of ``bins`` equal widths between the least and the greatest value: two passes, one row a bin."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    rows = df.where(F.col(column).isNotNull()).select(column).join(F.broadcast(ends), how="cross").withColumn("bin", place.cast("long"))  # one row of two values
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))


def layout_advice(df: DataFrame, filters: list[tuple[str, str]], few: int = 10_000) -> list[tuple[str, str, str]]:
    """(column, operator, advice) for each filter, from one pass over the columns' distinct counts."""
    columns = sorted({c for c, _ in filters})
    counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first().asDict() if columns else {}
    out = []
    for c, op in filters:
        if op in ("<", "<=", ">", ">=", "between"):
            advice = "sort: range pruning by row-group statistics"
        elif counts[c] <= few:
            advice = "partition or bitmap: few values"
        else:
            advice = "bloom filter and bucketing: point lookups on many values"
        out.append((c, op, advice))
    return out
