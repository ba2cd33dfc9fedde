"""Intermediate tables in the folder that the cluster shares for checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Spark deletes the shuffle files of a statement when it ends, if this is set.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where none is set, a temporary one for a local master, and an error for others."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that the cluster shares")
        named = tempfile.mkdtemp(prefix="basalt-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Parquet tables under one folder of the shared store.

    A written table cuts the lineage: a lost executor costs the tasks it ran, never earlier stages.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/basalt-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write and read again."""
        path = f"{self.root}/{name}"
        self._write(lambda: df.write.mode("overwrite").parquet(path))
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, df: DataFrame, name: str) -> DataFrame:
        """Add rows to a table and read all of it."""
        path = f"{self.root}/{name}"
        self._write(lambda: df.write.mode("append").parquet(path))
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, table: str, buckets: int, key: str) -> DataFrame:
        """Write as a bucketed table ``table``, to be dropped by the caller: groups by ``key`` need no shuffle."""
        path = f"{self.root}/{name}"
        self._write(lambda: df.write.mode("overwrite").bucketBy(buckets, key).option("path", path).saveAsTable(table))
        return self.spark.table(table)

    def _write(self, write: Callable[[], None]) -> None:
        """The shuffle files behind a table go with the statement that wrote it."""
        conf = self.spark.conf
        before = conf.get(TIDY, None)
        conf.set(TIDY, "true")
        try:
            write()
        finally:
            conf.unset(TIDY) if before is None else conf.set(TIDY, before)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads; without names, all of them."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def plain(df: DataFrame, **kinds: str) -> DataFrame:
    """Just the named columns, cast; extra columns, whatever their names (case apart too), go no further."""
    names = df.columns
    low = [n.lower() for n in names]
    place = {c: names.index(c) if c in names else low.index(c.lower()) for c in kinds}
    numbered = df.toDF(*[f"c{i}" for i in range(len(names))])
    return numbered.select(*[numbered[f"c{place[c]}"].cast(kind).alias(c) for c, kind in kinds.items()])
