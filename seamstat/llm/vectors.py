"""Reading of vector columns from Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def usable(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows whose vector is not null, holds only finite components and is not zero; the vectors.

    The vectors are grouped by length: parallel lists would not form one matrix. Returned are the
    row numbers and, in the same order, the vectors as double arrays.
    """
    rows, vectors = [], []
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.values if hasattr(column, "values") else column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    offsets = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for row in np.flatnonzero(valid):
        vector = values[offsets[row] : offsets[row + 1]]
        if len(vector) and np.isfinite(vector).all() and vector.any():
            rows.append(row)
            vectors.append(vector)
    return np.array(rows, np.int64), vectors


def by_dimension(vectors: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(dimension, indices) of the vectors of each length."""
    sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
    return [(int(size), np.flatnonzero(sizes == size)) for size in np.unique(sizes)]


def unpack(packed: list[bytes]) -> np.ndarray:
    """A matrix from the bytes of double vectors of one length."""
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)
