"""A catalogue of layouts that stand for indexes: created by name, chosen by the predicate, read instead of the table.

Kinds: ``btree`` (range-sorted), ``hash`` (bloom-filtered and sorted by the column's hash), ``bitmap`` (rows
of each value as bitmaps). A layout holds its key, the included columns and, unless some are named, all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats
from .workspace import delete, workspace


@dataclass(frozen=True)
class Layout:
    name: str
    table: str
    columns: tuple[str, ...]
    kind: str
    path: str
    holds: tuple[str, ...]


#: By kind of layout, the kinds of predicates it answers and what a row costs beside a full scan's 1.
COSTS = {"hash": {"=": 0.01, "in": 0.02}, "btree": {"=": 0.02, "in": 0.05, "range": 0.1}, "bitmap": {"=": 0.05, "in": 0.05}}


class Layouts:
    def __init__(self, spark: SparkSession):
        self.spark, self.known, self.uses = spark, {}, {}

    def create(self, name: str, table: str, df: DataFrame, columns: list[str], kind: str = "btree", include: list[str] | None = None) -> Layout:
        if name in self.known:
            raise ValueError(f"index {name} exists")
        if kind not in COSTS:
            raise ValueError(f"unknown kind {kind}")
        path = workspace(self.spark, f"index-{name}")
        held = df.select(*dict.fromkeys([*columns, *include])) if include else df
        if kind == "bitmap":
            formats.write(formats.bitmap_index(df, columns[0], columns[1]), path)
        elif kind == "hash":
            formats.write_bloom(held.repartition(*columns).sortWithinPartitions(*columns), path, columns)
        else:
            formats.write_sorted(held, path, columns)
        self.known[name] = Layout(name, table, tuple(columns), kind, path, tuple(held.columns))
        return self.known[name]

    def drop(self, name: str) -> None:
        delete(self.spark, self.known.pop(name).path)

    def choose(self, table: str, column: str, op: str, needed: list[str]) -> Layout | None:
        """The cheapest layout of the table that answers the predicate and holds the columns; None: scan."""
        kind = op if op in ("=", "in") else "range"
        fits = [x for x in self.known.values() if x.table == table and x.columns[0] == column and x.kind != "bitmap" and kind in COSTS[x.kind] and set(needed) <= set(x.holds)]
        best = min(fits, key=lambda x: (COSTS[x.kind][kind], x.name), default=None)
        self.uses[best.name if best else "scan"] = self.uses.get(best.name if best else "scan", 0) + 1
        return best

    def lookup(self, table: str, df: DataFrame, column: str, op: str, value, needed: list[str]) -> DataFrame:
        """Rows by one predicate: ``=``, ``in``, ``between``, ``<``, ``<=``, ``>`` or ``>=``."""
        best = self.choose(table, column, op, needed)
        rows = formats.read(self.spark, best.path) if best else df
        c = F.col(column)
        hit = {"=": lambda: c == value, "in": lambda: c.isin(value), "between": lambda: c.between(*value), "<": lambda: c < value, "<=": lambda: c <= value, ">": lambda: c > value, ">=": lambda: c >= value}[op]()
        return rows.where(hit).select(*needed)

    def statistics(self) -> DataFrame:
        """name, table_name, kind, columns, rows, uses of each layout."""
        rows = [(x.name, x.table, x.kind, ",".join(x.columns), formats.read(self.spark, x.path).count(), self.uses.get(x.name, 0)) for x in self.known.values()]
        return self.spark.createDataFrame(rows, "name string, table_name string, kind string, columns string, rows long, uses long")
