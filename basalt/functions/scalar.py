"""Scalar helpers: JSON paths and arrays in PostgreSQL's spelling, all built-ins underneath."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(column: str | Column, key: str) -> Column:
    """``column ->> 'key'``."""
    return F.get_json_object(column, f"$.{key}")


def array_append_all(a: str | Column, b: str | Column) -> Column:
    """``a || b`` of arrays."""
    return F.concat(a, b)


def day(column: str | Column) -> Column:
    """``DATE(ts)``."""
    return F.to_date(column)
