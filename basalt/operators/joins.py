"""Joins: every type under a chosen physical strategy, and joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The planner's hints; ``auto`` leaves the choice to statistics and adaptive execution.
STRATEGIES = {"auto": None, "broadcast": "broadcast", "merge": "merge", "hash": "shuffle_hash", "nested_loop": "shuffle_replicate_nl"}
BROADCAST_LIMIT = 64 << 20


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a relation's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join(left: DataFrame, right: DataFrame, on: Column | list[Column], how: str = "inner", strategy: str = "auto") -> DataFrame:
    """Join with SQL's NULL rules. A broadcast is only asked for where the right side's estimate is under 64 MB; else it is a sort-merge join."""
    hint = STRATEGIES[strategy]
    if hint == "broadcast" and size_in_bytes(right) > BROADCAST_LIMIT:
        hint = "merge"
    return left.join(right.hint(hint) if hint else right, on, how)


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Inner join on ``low <= point < high`` by equal buckets of ``width``: no nested loop, one row a pair.

    An interval is repeated for each bucket it meets, so ``width`` should be near the usual length.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width))
    spread = right.withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    keyed = left.withColumn("_bucket", bucket(point))
    return keyed.join(spread, "_bucket").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bucket")


def interval_join(left: DataFrame, right: DataFrame, low: str, high: str, other_low: str, other_high: str, width: float) -> DataFrame:
    """Inner join of half-open intervals that overlap, by equal buckets of ``width``; a pair is made in the first bucket both meet."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(width))
    one = left.where(F.col(low) < F.col(high)).withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    two = right.where(F.col(other_low) < F.col(other_high)).withColumn("_bucket", F.explode(F.sequence(bucket(other_low), bucket(other_high))))
    meet = (F.col(low) < F.col(other_high)) & (F.col(other_low) < F.col(high))
    first = F.col("_bucket") == F.greatest(bucket(low), bucket(other_low))
    return one.join(two, "_bucket").where(meet & first).drop("_bucket")


#: Rows of a key, of either side, that meet in one part of a spread join; and pairs that a task of it looks at.
PART_ROWS = 2048
TASK_PAIRS = 1 << 25


def inequality_join(left: DataFrame, right: DataFrame, key: str, other: str, value: str, bound: str, how: str = "inner", part_rows: int = PART_ROWS) -> DataFrame:
    """Join on ``key = other AND value > bound``, for keys so few that each has many rows: no task has a whole key.

    A key's rows are cut into parts of about ``part_rows`` by a hash of the row, on either side, and every two parts meet
    once; rows alike in all columns stay in one part. What has no partner is known from the least ``bound`` and the
    greatest ``value`` of its key, so no pairs are made for it. The keys' rows are counted when this is called; names
    of the two sides must differ.
    """
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"unknown join {how}")
    count = lambda df, k, n: df.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("_k")).agg(F.count("*").cast("double").alias(n))
    cuts = lambda n: F.ceil(F.col(n) / part_rows).cast("int")
    sizes = count(left, key, "_n").join(count(right, other, "_m"), "_k").select("*", cuts("_n").alias("_rows"), cuts("_m").alias("_columns"))
    work = F.sum(F.col("_n") * F.col("_m")) / TASK_PAIRS + F.sum(F.col("_n") * F.col("_columns") + F.col("_m") * F.col("_rows")) / (1 << 20)
    many = F.greatest("_n", "_m") > part_rows
    tasks, large = sizes.agg(F.coalesce(F.ceil(work), F.lit(1)).cast("long"), F.count_if(many)).first()
    large_keys = sizes.where(many).select("_k", "_rows", "_columns").hint("broadcast" if large <= BROADCAST_LIMIT >> 6 else "merge")

    def parts(df: DataFrame, k: str, own: str, facing: str) -> DataFrame:
        n = lambda c: F.coalesce(F.col(c), F.lit(1))
        dealt = df.where(F.col(k).isNotNull()).join(large_keys, F.col(k) == F.col("_k"), "left")
        at = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), n(own)).cast("int").alias(f"{own}_at")
        return dealt.select(*df.columns, at, F.explode(F.sequence(F.lit(0), n(facing) - 1)).alias(f"{facing}_at")).repartition(int(tasks), k, "_rows_at", "_columns_at")

    one, two = parts(left, key, "_rows", "_columns"), parts(right, other, "_columns", "_rows")
    met = (one[key] == two[other]) & (one["_rows_at"] == two["_rows_at"]) & (one["_columns_at"] == two["_columns_at"]) & (one[value] > two[bound])
    out = one.join(two.hint("merge"), met).select(*left.columns, *right.columns)
    if how in ("left", "full"):
        least = right.groupBy(F.col(other).alias("_k")).agg(F.min(bound).alias("_least"))
        alone = left.join(least, F.col(key) == F.col("_k"), "left").where(~F.coalesce(F.col(value) > F.col("_least"), F.lit(False)))
        out = out.unionByName(alone.select(*left.columns), allowMissingColumns=True)
    if how in ("right", "full"):
        most = left.groupBy(F.col(key).alias("_k")).agg(F.max(value).alias("_most"))
        alone = right.join(most, F.col(other) == F.col("_k"), "left").where(~F.coalesce(F.col("_most") > F.col(bound), F.lit(False)))
        out = out.unionByName(alone.select(*right.columns), allowMissingColumns=True)
    return out


def join_statistics(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """left_rows, right_rows, matched_rows and matched_keys of an equi-join, from counts by key: no joined row is made."""
    one = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("a"))
    two = right.where(F.col(other).isNotNull()).groupBy(F.col(other).alias("k")).agg(F.count("*").alias("b"))
    met = F.coalesce(F.col("a"), F.lit(0)) * F.coalesce(F.col("b"), F.lit(0))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return one.join(two, "k", "full").agg(zero("a").alias("left_rows"), zero("b").alias("right_rows"), zero(met).alias("matched_rows"), zero((met > 0).cast("long")).alias("matched_keys"))


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str, alias: str) -> DataFrame:
    """Each left row with the right side's latest ``value`` at or before its ``time``, by one union and one window."""
    from pyspark.sql import Window

    names = left.columns
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    marks = right.select(*[F.col(c) if c in (key, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names], F.col(value).alias("_v"), F.lit(0).alias("_side"))
    order = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.unionByName(marks).withColumn(alias, F.last("_v", ignorenulls=True).over(order)).where("_side = 1").drop("_v", "_side")
