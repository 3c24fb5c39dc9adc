"""Vectors of an Arrow column as whole-number matrices, by their length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def quantised(lists: pa.Array, scale: int, width: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vectors (only `width` if given): floor(scale * component), the component as double. Null vectors and
    those with null or non-finite components are left out. A component has to fit 64 bits."""
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    flat = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    for n in np.unique(sizes[sizes >= 0]) if width is None else [width]:
        rows = np.flatnonzero(sizes == n)
        part = flat[starts[rows, None] + np.arange(n)]
        good = np.isfinite(part).all(axis=1)
        x = np.floor(part[good] * scale)
        if np.abs(x).max(initial=0) >= 2.0**63:
            raise OverflowError("a component does not fit 64 bits")
        if good.any():
            yield rows[good], x.astype(np.int64)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length, without nulls, as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def as_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1), pa.int64()))


def wide(x: np.ndarray, limit: int) -> np.ndarray:
    """x itself while its numbers are below `limit`, else as Python integers, which never overflow."""
    return x if not x.size or max(-int(x.min()), int(x.max())) < limit else x.astype(object)
