"""Vectorised hashing of words and byte strings of an Arrow text column.

All functions work on whole texts, a bounded number of bytes at a time (one text longer than the bound makes a
piece of its own).  Hashes are polynomials modulo 2**64 over a fixed random value for each byte, followed by a
64-bit mixer, so equal strings always have equal hashes on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_POW = np.ones(1, dtype=np.uint64)
_IPOW = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, kept between calls."""
    global _POW, _IPOW
    if len(_POW) < n:
        size = max(n, PIECE_BYTES + 1024)
        for name, base in (("_POW", _BASE), ("_IPOW", _INV)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            globals()[name] = np.multiply.accumulate(out)
    return _POW[:n], _IPOW[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pieces(col: pa.Array | pa.ChunkedArray, most: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``most`` bytes; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), len(col))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums c with which ``span_hash`` finds the hash of any byte range."""
    power, _ = _powers(len(data) + 1)
    c = np.empty(len(data) + 1, dtype=np.uint64)
    c[0] = 0
    np.cumsum(_BYTE_VALUE[data] * power[: len(data)], out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) of each range; the length takes part."""
    _, inverse = _powers(len(c))
    return mix64((c[end] - c[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the bounds of each row's words; words are runs of other than white space."""
    solid = np.zeros(len(data) + 2, dtype=bool)
    solid[1:-1] = ~SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True  # a word never runs over the end of a row
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | first[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | first[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and the bounds of each row's words."""
    start, end, bounds = word_spans(data, offsets)
    return span_hash(prefix_hash(LOWER[data]), start, end), bounds


def shingle_sets(col: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its ``words``-word shingles); a shorter text is one shingle, none is empty."""
    factor = mix64(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    for row, data, offsets in pieces(col):
        h, bounds = word_hashes(data, offsets)
        n = max(0, len(h) - words + 1)
        s = np.zeros(n, dtype=np.uint64)
        for j in range(words):
            s += h[j : j + n] * factor[j]
        s = mix64(s)
        for i in range(len(offsets) - 1):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= words:
                yield row + i, np.unique(s[a : b - words + 1])
            elif b > a:
                part = np.uint64((h[a:b] * factor[: b - a]).sum()) + np.uint64(b - a)
                yield row + i, mix64(np.array([part], dtype=np.uint64))
            else:
                yield row + i, np.zeros(0, dtype=np.uint64)
