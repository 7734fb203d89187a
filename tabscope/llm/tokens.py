"""Words of whole record batches in numpy: one pass over the batch's UTF-8 bytes,
no Python loop over words."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Multiplier of the word hash (odd, so it has an inverse modulo 2**64).
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
#: Words hashed together: bounds the temporary arrays for any length of text.
_CHUNK = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII that is neither a letter nor a digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offsets of its values; null is empty."""
    binary = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset: binary.offset + len(binary) + 1]
    data = binary.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def slices(column: pa.Array, rows: int = 1000, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(start, length) of consecutive pieces of a column of texts, of at most ``rows`` rows and ``size`` bytes (or one row)."""
    ends, start = utf8(column)[1], 0
    while start < len(column):
        fits = int(np.searchsorted(ends, ends[start] + size, side="right")) - 1 - start
        length = min(max(1, fits), rows, len(column) - start)
        yield start, length
        start += length


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't separators; none spans two texts."""
    inside = ~separator[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        starts[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span's bytes, equal for equal bytes anywhere."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(0, len(starts), _CHUNK):
        a, b = starts[k:k + _CHUNK], ends[k:k + _CHUNK]
        base = a[0]
        part = data[base:b[-1]].astype(np.uint64) + np.uint64(1)
        powers = np.full(len(part), _P, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * powers, dtype=np.uint64)])
        powers[1:] = np.uint64(_P_INV)
        np.multiply.accumulate(powers, out=powers)
        out[k:k + _CHUNK] = mixed((sums[b - base] - sums[a - base]) * powers[a - base])
    return out


def shingle_hashes(words: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one text, and the index of each run's first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - n + 1
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = mixed(h * np.uint64(_P) + words[j:j + m])
    at = np.flatnonzero(text_of[:m] == text_of[n - 1:])
    return h[at], at
