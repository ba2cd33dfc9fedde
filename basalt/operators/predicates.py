"""Filters as data: comparison leaves combined by AND, OR and NOT, turned into one Catalyst expression."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "between": lambda c, v: c.between(*v),
    "in": lambda c, v: c.isin(*v),
    "like": lambda c, v: c.like(v),
    "contains": lambda c, v: c.contains(v),
    "is null": lambda c, _: c.isNull(),
    "is not null": lambda c, _: c.isNotNull(),
}


@dataclass(frozen=True)
class Filter:
    """``op`` is a comparison of ``column`` with ``value`` (a value or a Column), or and / or / not over ``children``."""

    op: str
    column: str | None = None
    value: Any = None
    children: tuple[Filter, ...] = field(default=())

    def expression(self) -> Column:
        parts = [c.expression() for c in self.children]
        if self.op == "and":
            return reduce(lambda a, b: a & b, parts, F.lit(True))
        if self.op == "or":
            return reduce(lambda a, b: a | b, parts, F.lit(False))
        if self.op == "not":
            return ~parts[0]
        return _COMPARE[self.op](F.col(self.column), self.value)


def where(column: str, op: str, value: Any = None) -> Filter:
    return Filter(op, column, value)


def all_of(*children: Filter) -> Filter:
    return Filter("and", children=children)


def any_of(*children: Filter) -> Filter:
    return Filter("or", children=children)


def negate(child: Filter) -> Filter:
    return Filter("not", children=(child,))
