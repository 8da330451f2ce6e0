"""Integer vectors from float columns, and their passage to numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components stay below this, so that products and squares of them are exact in 64 bits.
BOUND = 1 << 26


def usable(vector: Column) -> Column:
    """Whether ``vector`` is there and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component, taken as double. A result of ``BOUND`` or more is refused with an error."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))
    large = F.exists(whole, lambda x: F.abs(x) >= BOUND)
    return F.when(large, F.raise_error(F.lit(f"a component of {BOUND // factor} or more"))).otherwise(F.transform(whole, lambda x: x.cast("int")))


def width(df: DataFrame, column: str) -> int:
    """Components of the longest vector; 0 for an empty table."""
    return df.agg(F.max(F.size(column))).first()[0] or 0


def matrix(column: pa.Array, wide: int) -> np.ndarray:
    """Rows of a list column as 64-bit integers; shorter ones are filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out
