"""Whole Arrow batches of text as arrays of bytes, words and shingles."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20


# Large arrays are mapped and returned when freed: workers live on from task to task, and what they hoard counts.
_LIBC = ctypes.CDLL(None) if sys.platform == "linux" else None
pa.set_memory_pool(pa.system_memory_pool())
if hasattr(_LIBC, "mallopt"):
    _LIBC.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    _LIBC.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

#: One 64-bit value per byte, from a rule (splitmix64).


def _splitmix(n: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) + _U(0x1234567)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_VALUE = _splitmix(256)
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class _Powers:
    """P**i and P**-i modulo 2**64, as far as they have been needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            up, down = np.full(size, _P, _U), np.full(size, _P_INV, _U)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def trim_memory() -> None:
    """At the end of a task: powers beyond the usual and free heap go back."""
    POWERS.up = POWERS.down = np.ones(1, _U)
    gc.collect()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that gives memory back at the end of each task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim_memory()

    return whole


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins (and the last ends) in the bytes of all. Null texts are empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2] if n else None
    return offsets, np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, end row, their bytes, and offsets from 0. Null texts are empty; a text is never cut."""
    offsets, data = text_bytes(column)
    n = len(column)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of each word: runs without ASCII white space, A-Z lower-cased."""
    if not len(data):
        e = np.empty(0, np.int64)
        return np.empty(0, _U), e, e, e
    solid = ~IS_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    first = offsets[1:-1]
    first = first[(first > 0) & (first < len(data))]  # a word ends with its text
    start[first] = solid[first]
    end[first - 1] = solid[first - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(LOWER_VALUE[data] * up[: len(data)], dtype=_U, out=total[1:])
    h = mix64((total[e] - total[s]) * down[s] + (e - s).astype(_U))
    return h, np.searchsorted(offsets, s, "right") - 1, s, e


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the k-word shingles of each row; with fewer words, of all its words as one."""
    rows = len(offsets) - 1
    h, row, _, _ = words_of(data, offsets)
    counts = np.bincount(row, minlength=rows)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    a = _U(0xA24BAED4963EE407)
    grams = np.empty(0, _U)
    if len(h) >= k:
        m = len(h) - k + 1
        grams = h[:m].copy()
        for j in range(1, k):
            grams *= a
            grams += h[j : m + j]
        grams = mix64(grams + _U(k))
    out = []
    for r in range(rows):
        b, n = bounds[r], counts[r]
        if n >= k:
            out.append(np.unique(grams[b : b + n - k + 1]))
        elif n:
            x = h[b : b + 1].copy()
            for j in range(1, n):
                x = x * a + h[b + j : b + j + 1]
            out.append(mix64(x + _U(n)))
        else:
            out.append(np.empty(0, _U))
    return out
