"""Vectors as exact integers, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True where the vector is there and all its components are finite numbers; an empty vector is."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def integers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, as long; components whose integer is no long come as the nearest long."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-9.0e18), F.least(F.lit(9.0e18), x.cast("double") * scale))))


def extent(rows: DataFrame, vector_col: str, *more: Column) -> tuple:
    """The greatest length of the vectors (of integers), the greatest component without its sign, and more aggregates; one pass, one row."""
    found = rows.agg(F.max(F.size(vector_col)), F.max(F.array_max(F.transform(vector_col, F.abs))), *more).collect()[0]
    return found[0] or 0, found[1] or 0, *found[2:]


def exact_kind(bound: int) -> np.dtype:
    """A type in which sums up to bound are exact: doubles while they are, for they multiply fastest, then longs."""
    if bound >= 1 << 62:
        raise ValueError("vectors with components this large have no result that fits a long")
    return np.dtype(np.float64 if bound < 1 << 53 else np.int64)


def matrix(column: pa.Array | pa.ChunkedArray, width: int, kind: np.dtype) -> np.ndarray:
    """A column of lists as rows of a matrix; shorter lists are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, flat = len(column), column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == n * width:
        return flat.reshape(n, width).astype(kind)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((n, width), dtype=kind)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as a column of lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), kind))
