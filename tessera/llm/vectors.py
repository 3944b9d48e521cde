"""Reading embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def usable(column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Of a column of lists: which rows hold a vector that is not null, not empty, not zero, and has no null or non-finite
    component; and by length, those rows and their vectors in double precision."""
    n = len(column)
    ok = np.zeros(n, dtype=bool)
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if not n:
        return ok, by
    lists = column.cast(pa.list_(column.type.value_type))
    offsets = lists.offsets.to_numpy()
    flat = lists.values.cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)  # null components become nan
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        x = values[offsets[rows][:, None] + np.arange(d)]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        ok[rows[good]] = True
        if good.any():
            by[d] = (rows[good], x[good])
    return ok, by


def packed(x: np.ndarray, column: pa.Array | None = None) -> list[bytes]:
    """Rows as bytes; of a column of single precision, in single precision."""
    single = column is not None and pa.types.is_float32(column.type.value_type)
    return [r.tobytes() for r in np.ascontiguousarray(x, dtype="<f4" if single else "<f8")]


def unpacked(raw: list[bytes], d: int) -> np.ndarray:
    """Rows of length d, in double precision."""
    flat = b"".join(raw)
    return np.frombuffer(flat, "<f4" if len(flat) == 4 * d * len(raw) else "<f8").reshape(len(raw), d).astype(float)
