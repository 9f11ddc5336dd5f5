"""Integer vectors from float arrays, for operators that score with exact integer arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = float(1 << 60)  # squared norm from which sums of products might leave 64 bits


def doubles(vec: Column) -> Column:
    return F.transform(vec, lambda e: e.cast("double"))


def finite(x: Column) -> Column:
    """True where a vector of doubles holds no null, NaN or infinity."""
    return F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))


def squared_norm(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e)


def floored(x: Column, scale: int) -> Column:
    """floor(scale * component) of a vector of doubles, as array<bigint>."""
    return F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("bigint"))


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the rows of each vector length in an Arrow list column without nulls."""
    size = np.asarray(column.value_lengths())
    return [(at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)) for d in np.unique(size) for at in [np.nonzero(size == d)[0]]]
