"""Words of many texts at once: byte classes, word bounds and 64-bit word hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(2024).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
KEPT_POWERS = 2_500_000
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: ``[^\x20\x09-\x0D]+``: everything but the six blanks.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and all bytes of non-ASCII characters; punctuation parts words.
WORD_BYTE = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    WORD_BYTE[_a:_b] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        both = []
        for b in (_BASE, _INVERSE):
            p = np.full(n + n // 2, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if n > KEPT_POWERS:  # a very long text's powers do not stay with the worker
            return both[0][:n], both[1][:n]
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with n + 1 entries; ``(H[b] - H[a]) * inverse**a`` is the hash of ``data[a:b]`` wherever it stands."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def spans(column: pa.Array, limit: int = 1_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(index of the first, slice) of runs of about ``limit`` bytes of texts, 4,096 texts at most."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)).astype(np.int64))
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = min(int(np.searchsorted(ends, before + limit)) + 1, start + 4096, len(column))
        yield start, column.slice(start, stop - start)
        start = stop


def blocks(column: pa.Array, limit: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """The same runs as lists of UTF-8 texts; null counts as empty. Only one run at a time leaves the Arrow batch."""
    for first, part in spans(column, limit):
        yield first, part.cast(pa.binary()).fill_null(b"").to_pylist()


def tokenise(texts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Words of ASCII-lower-cased texts: (hash, first byte, text number) of each, and the joined bytes.

    Texts are joined by a blank, which is no word byte.
    """
    joined = b" ".join(texts).lower() + b" "
    data = np.frombuffer(joined, np.uint8)
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), joined
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside[data]]).view(np.int8)))
    start, end = edges[0::2], edges[1::2]
    h = prefix_hash(data)
    _, down = powers(len(data) + 1)
    key = mix((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return key, start, np.searchsorted(bounds, start, side="right"), joined


def in_text(owner: np.ndarray, n: int) -> np.ndarray:
    """For sorted owners 0..n-1: where each owner's items begin, n + 1 entries."""
    return np.searchsorted(owner, np.arange(n + 1))
