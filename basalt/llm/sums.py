"""Sums of long integer vectors over tasks, of a size that the input does not change."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "block int, part int, sums binary"
LENGTH = 32_768


def emit(vector: np.ndarray, part: int) -> pa.RecordBatch:
    """The vector of one task as rows of blocks."""
    cuts = range(0, len(vector), LENGTH)
    return pa.record_batch(
        [
            pa.array(range(len(cuts)), pa.int32()),
            pa.array([part] * len(cuts), pa.int32()),
            pa.array([zlib.compress(vector[c : c + LENGTH].astype(np.int64).tobytes(), 1) for c in cuts], pa.binary()),
        ],
        names=["block", "part", "sums"],
    )


def _add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total: np.ndarray | int = 0
    for z in rows["sums"]:
        total = total + np.frombuffer(zlib.decompress(z), np.int64)
    return pd.DataFrame({"block": [key[0]], "part": [key[1] if len(key) > 1 else 0], "sums": [zlib.compress(total.tobytes(), 1)]})


def total(parts: DataFrame, length: int) -> np.ndarray:
    """The sum of all emitted vectors: added in two levels, so no group holds a row of every task."""
    some = parts.withColumn("part", F.pmod("part", F.lit(64))).groupBy("block", "part").applyInPandas(_add, SCHEMA)
    out = np.zeros(length, np.int64)
    for r in some.groupBy("block").applyInPandas(_add, SCHEMA).collect():
        v = np.frombuffer(zlib.decompress(r["sums"]), np.int64)
        out[r["block"] * LENGTH : r["block"] * LENGTH + len(v)] = v
    return out
