"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), any orderable type; root is its component's least node.

    Minima come from partial aggregation and are written before they are joined, so that both sides of
    a join are shuffles: adaptive execution can split the rows of a node with very many neighbours.
    Every step is written to the shared folder.
    Empty edges give an empty result.
    """
    now = scratch.table(edges.select("u", "v").where("u <> v").distinct(), "cc-0")
    before = None
    for step in range(1, most + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")), f"cc-least-{step}")
        large = both.join(least, F.col("u") == F.col("x")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = scratch.table(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), f"cc-down-{step}")
        low = scratch.table(down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m"), f"cc-low-{step}")
        small = down.join(low, F.col("u") == F.col("x")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        then = scratch.table(small.where("u <> v").distinct(), f"cc-{step}")
        mark = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        scratch.drop(f"cc-{step - 1}", f"cc-least-{step}", f"cc-down-{step}", f"cc-low-{step}")
        now = then
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
