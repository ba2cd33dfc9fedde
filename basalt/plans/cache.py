"""A result cache above Spark's: keyed by canonical plan, with TTL, LRU eviction, table invalidation and warming."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass
class Entry:
    df: DataFrame
    tables: frozenset[str]
    made: float


class ResultCache:
    """Keeps DataFrames persisted; the key is the plan's semantic hash and the versions of its tables."""

    def __init__(self, ttl: float = 1800, most: int = 100, clock: Callable[[], float] = time.monotonic, promote_after: int = 1):
        """``promote_after``: a plan is kept from so many accesses on; before, it is only counted."""
        self.ttl, self.most, self.clock, self.promote_after = ttl, most, clock, promote_after
        self.accesses: dict[tuple, int] = {}
        self.entries: OrderedDict[tuple, Entry] = OrderedDict()
        self.hits = self.misses = self.evictions = 0
        self.versions: dict[str, int] = {}

    def _key(self, df: DataFrame, tables: Iterable[str]) -> tuple:
        return df.semanticHash(), tuple(sorted((t, self.versions.get(t, 0)) for t in tables))

    def get(self, df: DataFrame, tables: Iterable[str] = ()) -> DataFrame:
        """The persisted result of an equal plan, else ``df``, persisted now."""
        tables = frozenset(tables)
        key = self._key(df, tables)
        self.sweep()
        if key in self.entries and self.entries[key].df.sameSemantics(df):
            self.hits += 1
            self.entries.move_to_end(key)
            return self.entries[key].df
        self.misses += 1
        self.accesses[key] = self.accesses.get(key, 0) + 1
        if self.accesses[key] < self.promote_after:
            return df
        self.accesses.pop(key)
        self.entries[key] = Entry(df.persist(), tables, self.clock())
        while len(self.entries) > self.most:
            self._drop(next(iter(self.entries)))
            self.evictions += 1
        return df

    def _drop(self, key: tuple) -> None:
        self.entries.pop(key).df.unpersist()

    def sweep(self) -> int:
        """Drop what is older than the TTL."""
        old = [k for k, e in self.entries.items() if self.clock() - e.made > self.ttl]
        for k in old:
            self._drop(k)
        return len(old)

    def invalidate(self, table: str) -> int:
        """A table was written: drop its results and count its version up."""
        self.versions[table] = self.versions.get(table, 0) + 1
        old = [k for k, e in self.entries.items() if table in e.tables]
        for k in old:
            self._drop(k)
        return len(old)

    def clear(self) -> None:
        for k in list(self.entries):
            self._drop(k)

    def warm(self, plans: Iterable[tuple[DataFrame, Iterable[str]]]) -> int:
        """Compute and keep results ahead of use; the rows stay on the executors."""
        n = 0
        for df, tables in plans:
            self.get(df, tables).write.format("noop").mode("overwrite").save()
            n += 1
        return n

    def stats(self) -> dict[str, int | float]:
        asked = self.hits + self.misses
        return {"entries": len(self.entries), "hits": self.hits, "misses": self.misses, "evictions": self.evictions, "hit_rate": self.hits / asked if asked else 0.0}
