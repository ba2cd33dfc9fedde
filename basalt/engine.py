"""The SQL entry point: queries, DML, DDL and transactions over a folder of Parquet tables and a store of own ones.

Spark's parser reads every statement; what it says of an INSERT, UPDATE, DELETE, CREATE or DROP is carried
out on snapshot tables in ``store``. Tables of ``folder`` are read only. A name means a table of the store
first, then a registered frame, then a table of the folder.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .sources.layouts import Layouts
from .sources.snapshots import SnapshotTable, Transaction
from .sources.workspace import delete, workspace

_RELATION = re.compile(r"UnresolvedRelation \[([^\]]+)\]")
_INDEX = re.compile(r"\s*create\s+index\s+(\w+)\s+on\s+(\w+)\s*(?:using\s+(\w+)\s*)?\(([^)]*)\)\s*(?:include\s*\(([^)]*)\))?\s*;?\s*$", re.IGNORECASE)
_DROP_INDEX = re.compile(r"\s*drop\s+index\s+(\w+)\s*;?\s*$", re.IGNORECASE)
_BLOCK = re.compile(r"\s*(begin|start\s+transaction|commit|end|rollback|abort)(?:\s+(?:transaction|work))?\s*;?\s*$", re.IGNORECASE)
_SAVEPOINT = re.compile(r"\s*(savepoint|rollback\s+to(?:\s+savepoint)?)\s+(\w+)\s*;?\s*$", re.IGNORECASE)


class Engine:
    def __init__(self, spark: SparkSession, folder: str | None = None, store: str | None = None):
        self.spark, self.folder = spark, folder
        self._store = store
        self.registered: dict[str, DataFrame] = {}
        self.block: dict[str, Transaction] | None = None
        self.layouts = Layouts(spark)

    @property
    def store(self) -> str:
        self._store = self._store or workspace(self.spark, "store")
        return self._store

    def _names(self, root: str) -> list[str]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def stored(self, name: str) -> SnapshotTable | None:
        if self._store is None and self.block is None:
            return None
        table = SnapshotTable(self.spark, f"{self.store}/{name}")
        return table if table.versions() else None

    def table(self, name: str) -> DataFrame:
        if self.block and name in self.block:
            return self.block[name].read()
        own = self.stored(name)
        if own:
            return own.read()
        if name in self.registered:
            return self.registered[name]
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def register(self, name: str, df: DataFrame) -> None:
        self.registered[name] = df

    def drop(self, name: str) -> bool:
        """Drop a table of the store or a registered frame."""
        if self.stored(name):
            delete(self.spark, f"{self.store}/{name}")
            return True
        return self.registered.pop(name, None) is not None

    def tables(self) -> list[str]:
        found = {n.removesuffix(".parquet") for n in self._names(self.folder) if n.endswith(".parquet")} if self.folder else set()
        found |= set(self._names(self._store)) if self._store else set()
        return sorted(found | set(self.registered))

    def columns(self) -> DataFrame:
        """information_schema.columns: table_name, column_name, ordinal_position, data_type, is_nullable."""
        rows = [(t, f.name, i, f.dataType.simpleString(), "YES" if f.nullable else "NO") for t in self.tables() for i, f in enumerate(self.table(t).schema, 1)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string")

    def sql(self, text: str, args: dict[str, Any] | list[Any] | None = None) -> DataFrame:
        """Run a statement; a query may have named (``:name``) or positional (``?``) parameters, bound as values, never as text.

        Statements other than queries return one row: n, the number of rows changed (0 for DDL).
        """
        if m := _BLOCK.match(text):
            return self._done(self._transaction(m.group(1).lower()))
        if m := _SAVEPOINT.match(text):
            for t in (self.block or {}).values():
                t.savepoint(m.group(2)) if m.group(1).lower() == "savepoint" else t.rollback_to(m.group(2))
            return self._done(0)
        if m := _INDEX.match(text):
            name, table, kind, columns, more = m.groups()
            split = lambda c: [x.strip() for x in (c or "").split(",") if x.strip()]
            self.layouts.create(name, table, self.table(table), split(columns), (kind or "btree").lower(), split(more))
            return self._done(0)
        if m := _DROP_INDEX.match(text):
            self.layouts.drop(m.group(1))
            return self._done(0)
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        kind = plan.getClass().getSimpleName()
        run = {"InsertIntoStatement": self._insert, "UpdateTable": self._update, "DeleteFromTable": self._delete, "CreateTable": self._create, "CreateTableAsSelect": self._create_as, "DropTable": self._drop}.get(kind)
        if kind == "ShowTables":
            return self.spark.createDataFrame([(t,) for t in self.tables()], "table_name string")
        if run:
            if args:
                raise ValueError("parameters are for queries")
            return self._done(self._with_views(plan, lambda: run(plan)))
        return self._with_views(plan, lambda: self.spark.sql(text, args=args) if args is not None else self.spark.sql(text))

    def _done(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "n long")

    def _with_views(self, plan, run):
        """Run with the relations that the plan names as views, gone again afterwards: frames are analysed by then."""
        catalog, made, hidden = self.spark.catalog, [], {}
        for name in sorted({n.split(",")[0].strip() for n in _RELATION.findall(plan.toString())}):
            try:
                df = self.table(name)
            except Exception:  # not a table: a view or an expression of the statement's own, which Spark resolves or reports
                continue
            if catalog.tableExists(name) and any(t.name == name and t.isTemporary for t in catalog.listTables()):
                hidden[name] = self.spark.table(name)
            df.createOrReplaceTempView(name)
            made.append(name)
        try:
            return run()
        finally:
            for name in made:
                catalog.dropTempView(name)
            for name, df in hidden.items():
                df.createOrReplaceTempView(name)

    # --- statements --------------------------------------------------------------------------------

    def _transaction(self, word: str) -> int:
        if word.startswith(("begin", "start")):
            if self.block is not None:
                raise RuntimeError("a transaction is open")
            self.block = {}
            return 0
        if self.block is None:
            raise RuntimeError("no transaction is open")
        block, self.block = self.block, None
        for t in block.values():
            t.commit() if word in ("commit", "end") else t.rollback()
        return len(block)

    def _write(self, name: str, change) -> int:
        table = self.stored(name)
        if table is None:
            raise ValueError(f"no table {name} in the store")
        if self.block is None:
            with table.begin() as t:
                return change(t)
        if name not in self.block:
            self.block[name] = table.begin()
        return change(self.block[name])

    def _frame(self, plan) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan), self.spark)

    def _name(self, relation) -> str:
        parts = relation.multipartIdentifier() if relation.getClass().getSimpleName() == "UnresolvedRelation" else relation.nameParts()
        return parts.last()

    def _list(self, seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def _insert(self, plan) -> int:
        rows, name = self._frame(plan.query()), self._name(plan.table())
        named = self._list(plan.userSpecifiedCols())

        def change(t: Transaction) -> int:
            names = named or t.schema.names
            if len(names) != len(rows.columns) or set(names) - set(t.schema.names):
                raise ValueError(f"{len(rows.columns)} values for columns {names}")
            given = rows.toDF(*names)
            missing = {f.name: F.lit(None).cast(f.dataType) for f in t.schema if f.name not in names}
            return t.table.frame(t.schema, t.insert(given.withColumns(missing) if missing else given)).count()

        return self._write(name, change)

    def _update(self, plan) -> int:
        values = {}
        for a in self._list(plan.assignments()):
            values[a.key().nameParts().last()] = F.expr(a.value().sql())
        where = F.expr(plan.condition().get().sql()) if plan.condition().isDefined() else None
        return self._write(self._name(plan.table()), lambda t: t.update(where, values))

    def _delete(self, plan) -> int:
        text = plan.condition().sql()
        return self._write(self._name(plan.table()), lambda t: t.delete(None if text == "true" else F.expr(text)))

    def _create(self, plan) -> int:
        name = self._name(plan.name())
        columns = [json.loads(c.dataType().json()) for c in self._list(plan.columns())]
        names = [(c.name(), c.nullable()) for c in self._list(plan.columns())]
        schema = StructType([StructField.fromJson({"name": n, "type": t, "nullable": null, "metadata": {}}) for (n, null), t in zip(names, columns, strict=True)])
        if self.stored(name) and plan.ignoreIfExists():
            return 0
        SnapshotTable.define(self.spark, schema, f"{self.store}/{name}")
        return 0

    def _create_as(self, plan) -> int:
        name = self._name(plan.name())
        if self.stored(name) and plan.ignoreIfExists():
            return 0
        return SnapshotTable.create(self._frame(plan.query()), f"{self.store}/{name}").read().count()

    def _drop(self, plan) -> int:
        if not self.drop(self._name(plan.child())) and not plan.ifExists():
            raise ValueError(f"no table {self._name(plan.child())}")
        return 0
