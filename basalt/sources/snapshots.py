"""Tables with INSERT, UPDATE, DELETE and transactions over immutable Parquet files.

A version is a manifest ``_log/n``: the schema and the list of its data files. INSERT adds files; UPDATE and
DELETE find the files with rows that match and write only these anew. A commit writes the manifest under a
name of its own and then gives it its number, which only one writer can: by a hard link on local and
network file systems, by a rename that does not overwrite on HDFS. Readers see a manifest whole or not at
all, and a crash leaves files that no manifest names. Object stores without such a rename are refused.

Readers pin a version and see nothing of later ones. The first of two writers wins, the other gets a
Conflict. An insert, which reads nothing of the table, is put after the winner's version instead.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .workspace import delete

STORES = ("file", "hdfs", "viewfs")


class Conflict(RuntimeError):
    """Another transaction committed first."""


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._where("").getFileSystem(self._conf)
        if self._fs.getScheme() not in STORES:
            raise ValueError(f"commits need a store of {', '.join(STORES)}, not {self._fs.getScheme()}")

    def _where(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @classmethod
    def create(cls, df: DataFrame, path: str) -> SnapshotTable:
        """A table with the rows of ``df``."""
        table = cls(df.sparkSession, path)
        if table.versions():
            raise Conflict(f"{path} exists")
        with Transaction(table, -1, df.schema, []) as t:
            t.insert(df)
        return table

    @classmethod
    def define(cls, spark: SparkSession, schema: StructType, path: str) -> SnapshotTable:
        """A table without rows."""
        table = cls(spark, path)
        if table.versions():
            raise Conflict(f"{path} exists")
        table._commit(0, schema, [])
        return table

    def versions(self) -> list[int]:
        if not self._fs.exists(self._where("_log")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._where("_log"))]
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        return max(self.versions(), default=-1)

    def manifest(self, n: int) -> tuple[StructType, list[str]]:
        lines = self.spark.read.text(f"{self.path}/_log/{n}", wholetext=True).first()[0]
        known = json.loads(lines)
        return StructType.fromJson(known["schema"]), known["files"]

    def _commit(self, n: int, schema: StructType, files: list[str]) -> None:
        draft = self._where(f"_log/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps({"schema": json.loads(schema.json()), "files": files}).encode())
        out.close()
        try:
            if self._fs.getScheme() == "file":
                os.link(urlparse(str(draft.toString())).path, urlparse(str(self._where(f"_log/{n}").toString())).path)
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
                context.rename(draft, self._where(f"_log/{n}"), self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if self._fs.exists(self._where(f"_log/{n}")):
                raise Conflict(f"version {n} was committed by another transaction") from e
            raise
        finally:
            self._fs.delete(draft, False)

    def frame(self, schema: StructType, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in files])

    def read(self, version: int | None = None) -> DataFrame:
        """The newest, or the given, committed snapshot."""
        return self.frame(*self.manifest(self.version() if version is None else version))

    def _write(self, df: DataFrame) -> list[str]:
        """New data files with the rows of ``df``, by their paths in the table."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return sorted(f"{folder}/{s.getPath().getName()}" for s in self._fs.listStatus(self._where(folder)) if s.getPath().getName().endswith(".parquet"))

    def begin(self, version: int | None = None) -> Transaction:
        n = self.version() if version is None else version
        return Transaction(self, n, *self.manifest(n))

    def insert(self, df: DataFrame) -> None:
        with self.begin() as t:
            t.insert(df)

    def update(self, where: Column | None, values: dict[str, Column]) -> int:
        with self.begin() as t:
            return t.update(where, values)

    def delete(self, where: Column | None = None) -> int:
        with self.begin() as t:
            return t.delete(where)

    def vacuum(self, keep: int = 1) -> list[int]:
        """Delete all but the newest ``keep`` versions and the files that only these name; returns those deleted."""
        known = self.versions()
        old, kept = known[: -keep or None], known[-keep:] if keep else []
        named = {f for n in kept for f in self.manifest(n)[1]}
        for f in {f for n in old for f in self.manifest(n)[1]} - named:
            self._fs.delete(self._where(f), False)
        for n in old:
            self._fs.delete(self._where(f"_log/{n}"), False)
        return old


class Transaction:
    """Reads its own writes; commit publishes them, rollback (or an error in a ``with`` block) drops them."""

    def __init__(self, table: SnapshotTable, base: int, schema: StructType, files: list[str]):
        self.table, self.base, self.schema = table, base, schema
        self.files, self.made, self.open = list(files), [], True
        self.changed = self.rewrote = False
        self.savepoints: dict[str, tuple] = {}

    def read(self) -> DataFrame:
        return self.table.frame(self.schema, self.files)

    def _check(self) -> None:
        if not self.open:
            raise RuntimeError("the transaction is closed")

    def _add(self, df: DataFrame) -> list[str]:
        new = self.table._write(df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema]))
        self.files, self.made, self.changed = self.files + new, self.made + new, True
        return new

    def insert(self, df: DataFrame) -> list[str]:
        """Add rows; returns the files that hold them."""
        self._check()
        return self._add(df)

    def _rewrite(self, where: Column | None, change) -> int:
        """Files with rows that match are written anew by ``change(rows, hit)``; the number of such rows."""
        self._check()
        hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
        found = self.read().where(hit).groupBy(F.input_file_name().alias("f")).count().collect() if self.files else []
        n = sum(r["count"] for r in found)
        names = {unquote(r["f"]).rpartition("/")[2] for r in found}
        touched = [f for f in self.files if f.rpartition("/")[2] in names]
        if touched:
            rows = change(self.table.frame(self.schema, touched), hit)
            self.files = [f for f in self.files if f not in set(touched)]
            self.changed = self.rewrote = True
            if rows is not None:
                self._add(rows)
        return n

    def update(self, where: Column | None, values: dict[str, Column]) -> int:
        def change(rows: DataFrame, hit: Column) -> DataFrame:
            return rows.select(*[F.when(hit, values[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c in rows.columns])

        if unknown := set(values) - set(self.schema.names):
            raise ValueError(f"no columns {sorted(unknown)}")
        return self._rewrite(where, change)

    def delete(self, where: Column | None = None) -> int:
        return self._rewrite(where, lambda rows, hit: rows.where(~hit) if where is not None else None)

    def savepoint(self, name: str) -> None:
        self._check()
        self.savepoints[name] = (list(self.files), self.changed, self.rewrote)

    def rollback_to(self, name: str) -> None:
        self._check()
        files, self.changed, self.rewrote = self.savepoints[name]
        self.files = list(files)

    def commit(self) -> int:
        """The version committed. Only inserts go after versions committed meanwhile; other changes would be lost updates."""
        self._check()
        if not self.changed:
            self.open = False
            return self.base
        t, base, files = self.table, self.base, self.files
        while True:
            try:
                t._commit(base + 1, self.schema, files)
                self.open = False
                return base + 1
            except Conflict:
                if self.rewrote or self.base < 0:
                    self.rollback()
                    raise
                base = t.version()
                files = t.manifest(base)[1] + [f for f in self.made if f in set(self.files)]

    def rollback(self) -> None:
        for folder in {f.rpartition("/")[0] for f in self.made}:
            delete(self.table.spark, f"{self.table.path}/{folder}")
        self.made, self.open = [], False

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.open and kind is None:
            self.commit()
        elif self.open:
            self.rollback()
