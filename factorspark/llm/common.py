"""Shared helpers: private column names, numbered rows, bounded samples, Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.runtime import materialise

SCALE = float(2**53)


def private(frame: DataFrame, *names: str) -> list[str]:
    """Names close to `names` that no column of `frame` has, whatever the case."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(frame: DataFrame, label: str, name: str) -> DataFrame:
    """The rows stored once in the shared folder, each with a unique number in `name`."""
    return materialise(frame.withColumn(name, F.monotonically_increasing_id()), label)


def uniform(*columns) -> Column:
    """A number in [0, 1) that depends only on the values of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(SCALE)


def hashed_share(count: int, wanted: int) -> float:
    """The share of `count` rows to keep for about `wanted` of them."""
    return 1.0 if count <= wanted else wanted / count


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0]: ends[-1]], ends - ends[0]


def vectors(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls, all of one width, as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), width)
