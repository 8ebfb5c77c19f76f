"""Vectors as numpy blocks, shared by the near-duplicate join and the search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """float64 rows (shorter vectors are padded with zeros) and which of them are whole: not null, nothing null or not finite inside."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    rows, ok = [], np.zeros(n, bool)
    for i, v in enumerate(column):
        a = None
        if v.is_valid and v.values.null_count == 0:
            a = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            a = a if len(a) and np.isfinite(a).all() else None
        rows.append(a)
        ok[i] = a is not None
    width = max((len(a) for a in rows if a is not None), default=0)
    x = np.zeros((n, width))
    for i, a in enumerate(rows):
        if a is not None:
            x[i, : len(a)] = a
    return x, ok


def to_blob(x: np.ndarray) -> bytes:
    """Rows of one width, with that width in front."""
    return np.int64(x.shape[1]).tobytes() + np.ascontiguousarray(x).tobytes()


def from_blob(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(blob, kind, -1, 8).reshape(-1, int(np.frombuffer(blob, np.int64, 1)[0]) or 1)


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
