"""Arrays of numbers inside binary columns, and rows of which most columns are null."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers in which every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def planes(x: np.ndarray) -> bytes:
    """Integers byte by byte: first the highest bytes of all, last the lowest; equal bytes in a row compress well."""
    x = np.ascontiguousarray(x)
    return x.astype(x.dtype.newbyteorder(">")).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def of_planes(x: bytes | None, kind: str = "u8") -> np.ndarray:
    width = np.dtype(kind).itemsize
    found = np.ascontiguousarray(np.frombuffer(x or b"", dtype=np.uint8).reshape(width, -1).T).view(f">{kind}").ravel()
    return found.astype(kind)


def numbers(x: bytes | None, kind: str) -> np.ndarray:
    return np.frombuffer(x or b"", dtype=kind)


def rows(types: dict[str, pa.DataType], count: int, **columns) -> pa.RecordBatch:
    """``count`` rows; columns that are not given are null."""
    arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], type=t) if c in columns else pa.nulls(count, t) for c, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(types))


def spread(number: int, buckets: int) -> int:
    """One of the buckets, neighbours in different ones."""
    return number * 2654435761 % buckets


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows begins."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(len(columns[0]), dtype=bool)
    new[0] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)
