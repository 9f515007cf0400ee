"""Numpy arrays as small bytes for a shuffle: one plane for each byte of the items, compressed together.

The first eight bytes hold the number of items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray) -> bytes:
    """The items' bytes, first bytes first."""
    n = len(values)
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(n, values.dtype.itemsize).T.tobytes() if n else b""
    return n.to_bytes(8, "little") + _CODEC.compress(planes, asbytes=True) if n else b""


def items(data: bytes) -> int:
    """How many items were packed."""
    return int.from_bytes(data[:8], "little")


def unpack(data: bytes, dtype: str) -> np.ndarray:
    kind, n = np.dtype(dtype), items(data)
    if not n:
        return np.zeros(0, kind)
    planes = _CODEC.decompress(data[8:], decompressed_size=n * kind.itemsize, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def pack_rising(values: np.ndarray) -> bytes:
    """Never falling unsigned items by their differences, whose upper planes are mostly zero."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_rising(data: bytes, dtype: str) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def slices(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, begin, end) of each run of equal neighbours."""
    if not len(marks):
        return marks, np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.flatnonzero(marks[1:] != marks[:-1]) + 1])
    return marks[begin], begin, np.append(begin[1:], len(marks))
