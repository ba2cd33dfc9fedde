"""Materialised views: a query's rows in a snapshot table, refreshed whole or for the groups that changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from ..sources.snapshots import SnapshotTable


class MaterializedView:
    """``plan`` makes the rows anew; readers see the old rows or the new ones, never a mix."""

    def __init__(self, spark: SparkSession, path: str, plan: Callable[[], DataFrame]):
        self.plan, self.table = plan, SnapshotTable(spark, path)
        if not self.table.versions():
            self.table = SnapshotTable.create(plan(), path)

    def read(self) -> DataFrame:
        return self.table.read()

    def refresh(self, where: Column | None = None) -> int:
        """Replace all rows, or those that meet ``where``, a condition on the view's columns; the new version."""
        with self.table.begin() as t:
            t.delete(where)
            t.insert(self.plan().where(where) if where is not None else self.plan())
        return self.table.version()
