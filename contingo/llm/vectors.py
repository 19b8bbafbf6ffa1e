"""Vector columns as numpy matrices (task-side helpers)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Entries whose scaled floor lies beyond this are set to it, so that they stay exact integers in a double.
ENTRY_BOUND = 1 << 53


def list_lengths(column: pa.Array) -> np.ndarray:
    """Length of each list; -1 for a null list."""
    out = np.diff(column.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
    if column.null_count:
        out[~column.is_valid().to_numpy(zero_copy_only=False)] = -1
    return out


def whole_rows(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, their lengths) of the lists without a null or non-finite entry, of the given length only if
    one is given."""
    lengths = list_lengths(column)
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.values
    good = np.isfinite(entries.to_numpy(zero_copy_only=False).astype(np.float64))
    if entries.null_count:
        good &= entries.is_valid().to_numpy(zero_copy_only=False)
    bad_before = np.concatenate([[0], np.cumsum(~good)])
    fine = (lengths >= 0) & (bad_before[offsets[1:]] == bad_before[offsets[:-1]])
    if size is not None:
        fine &= lengths == size
    at = np.flatnonzero(fine)
    return at, lengths[at]


def matrix(column: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    """The lists of these rows, all of one length, as doubles."""
    if not len(rows) or not size:
        return np.zeros((len(rows), size))
    starts = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)[rows]
    entries = column.values.to_numpy(zero_copy_only=False)
    return entries[starts[:, None] + np.arange(size)].astype(np.float64)


def scaled_floor(values: np.ndarray, scale: float, bound: int = ENTRY_BOUND) -> np.ndarray:
    """floor(scale * value) as integers, held within the bound."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * scale), -bound, bound).astype(np.int64)
