"""Vectors in Arrow columns as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) for each length among the usable vectors of a list column.

    A vector is usable if it is not NULL and holds neither NULL nor a non-finite number.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # NULL becomes NaN
    sizes = np.diff(offsets)
    there = np.asarray(column.is_valid())
    for size in np.unique(sizes[there]).tolist():
        rows = np.flatnonzero(there & (sizes == size))
        matrix = flat[offsets[rows][:, None] + np.arange(size)[None, :]]
        good = np.isfinite(matrix).all(axis=1)
        if good.any():
            yield rows[good], matrix[good]
