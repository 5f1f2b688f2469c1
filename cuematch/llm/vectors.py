"""Vector columns as matrices within tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cuematch.llm.words import mixed

_U = np.uint64


def valid_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors (double) per length, without null, empty, zero and non-finite vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten()  # leaves null lists out
    numbers = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    if values.null_count:
        numbers = np.where(values.is_null().to_numpy(zero_copy_only=False), np.nan, numbers)
    start = np.cumsum(length) - length
    for size in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == size)
        matrix = numbers[start[rows][:, None] + np.arange(size)]
        good = np.isfinite(matrix).all(1) & (matrix != 0).any(1)
        if good.any():
            yield rows[good], matrix[good]


def units(matrix: np.ndarray) -> np.ndarray:
    """Vectors of length one; very large and small numbers are scaled first."""
    matrix = matrix / np.abs(matrix).max(1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True))


def row_codes(matrix: np.ndarray) -> np.ndarray:
    """A 63-bit code of each row's numbers; -0.0 counts as 0.0."""
    bits = (matrix + 0.0).view(_U)
    code = np.full(len(matrix), matrix.shape[1], _U)
    for i in range(matrix.shape[1]):
        code = mixed(code * _U(0x9E3779B97F4A7C15) + bits[:, i])
    return (code >> _U(1)).astype(np.int64)


def blob(matrix: np.ndarray) -> pa.Array:
    """Rows as bytes of doubles."""
    data = np.ascontiguousarray(matrix, "<f8")
    return pa.array([r.tobytes() for r in data], pa.binary())


def from_blobs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix per length, of a column made by ``blob``."""
    length = pc.binary_length(column).to_numpy(zero_copy_only=False)
    rows_ = column.to_pylist()
    for size in np.unique(length):
        rows = np.flatnonzero(length == size)
        yield rows, np.frombuffer(b"".join(rows_[i] for i in rows), "<f8").reshape(len(rows), -1)
