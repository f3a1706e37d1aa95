"""Vectors of an Arrow batch as a matrix; shared by the search and the near-duplicate operator."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrices(column: pa.Array):
    """(rows, matrix) for each length of vectors among the usable ones, as doubles.

    A vector that is null or holds null or non-finite components is not usable.
    """
    column = column.cast(pa.large_list(pa.float64()))
    rows = np.arange(len(column))
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.values.to_numpy(zero_copy_only=False)  # null components are NaN
    for size in np.unique(sizes[there]):
        some = rows[there & (sizes == size)]
        block = flat[offsets[some][:, None] + np.arange(size)].reshape(len(some), size)
        fine = np.isfinite(block).all(axis=1)
        if fine.any():
            yield some[fine], block[fine]
