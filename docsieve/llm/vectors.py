"""Vectors of Arrow list columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def finite_vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix of doubles) of the vectors with ``size`` entries, none null or non-finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not size or not len(column):
        return np.zeros(0, np.int64), np.zeros((0, size))
    offsets = np.asarray(column.offsets).astype(np.int64)
    rows = np.flatnonzero((np.diff(offsets) == size) & np.asarray(column.is_valid()))
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    matrix = values[offsets[rows][:, None] + np.arange(size)] if len(rows) else np.zeros((0, size))
    fine = np.isfinite(matrix).all(axis=1)
    return rows[fine], matrix[fine]


def list_column(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as an Arrow list column, one list a row."""
    n, size = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, max(size, 1), dtype=np.int32) if size else np.zeros(n + 1, np.int32)),
                                    pa.array(matrix.ravel(), kind))
