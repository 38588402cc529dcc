"""Columns of vectors, and their rows as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for vectors that are there and hold finite numbers only."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, number)


def padded(vector: Column, width: int) -> Column:
    """Shorter vectors with zeros at the end, which change no inner product."""
    gap = F.greatest(F.lit(width) - F.size(vector), F.lit(0))
    return F.concat(vector, F.array_repeat(F.lit(0), gap))


def matrix(column: pa.Array | pa.ChunkedArray, width: int, dtype: type) -> np.ndarray:
    """Lists of ``width`` numbers as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype).reshape(len(column), width)


def blocks(total: int, size: int) -> int:
    """How many blocks of about ``size`` rows hold ``total`` rows."""
    return max(1, -(-total // size))


def block_of(key: Column, count: int, seed: int = 0) -> Column:
    """A block for each key, the same for equal keys, even whatever the keys are."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(count)).cast("int")


def in_each_block(rows: DataFrame, name: str, count: int) -> DataFrame:
    """Every row once for each block of the other side."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
