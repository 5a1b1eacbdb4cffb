"""Vectorised byte kernels over Arrow text columns.

The functions work on one Arrow batch at a time inside a Spark task: they turn
a text column into flat NumPy arrays (bytes, word spans, rolling hashes), so the
per-word work costs a few nanoseconds and never a Python loop.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: The separators of the two word rules (ASCII white space, and
#: every ASCII byte that is no letter or digit).
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:0x80] = True
NON_ALNUM[0x30:0x3A] = NON_ALNUM[0x41:0x5B] = NON_ALNUM[0x61:0x7B] = False
#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BASE2 = np.uint64(0xD1342543DE82EF95)
_BASE2_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (spreads a polynomial hash over all bits)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunk at all
            column = pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 17):
    """Row ranges of about ``most`` bytes each; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray):
    """Start, end and row of every maximal run of bytes outside ``sep``; runs end at row ends."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    keep = ~sep[data]
    first, last = keep.copy(), keep.copy()
    first[1:] &= ~keep[:-1]
    last[:-1] &= ~keep[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = keep[cuts]
    last[cuts - 1] = keep[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


_KNOWN: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2 ... modulo 2**64; kept for the next call, as pieces are of like size."""
    out = _KNOWN.get(int(base))
    if out is None or len(out) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if len(out) <= 1 << 23:  # longer ones, for very long texts, are not kept
            _KNOWN[int(base)] = out
    return out[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` for many spans at once, by prefix sums modulo 2**64."""
    base, inverse = (_BASE2, _BASE2_INV) if second else (_BASE, _BASE_INV)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=prefix[1:])
    out = prefix[ends] - prefix[starts]
    out *= _powers(inverse, len(values) + 1)[starts]
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(_BYTE[data], starts, ends)


def hashed_words(column, sep: np.ndarray = SPACE, lower: bool = False):
    """Hash of every word of the column, and the number of words of each row."""
    data, offsets = flat(column)
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for a, b in pieces(offsets):
        part = data[offsets[a] : offsets[b]]
        if lower:
            part = LOWER[part]
        starts, ends, row = word_spans(part, offsets[a : b + 1] - offsets[a], sep)
        hashes.append(word_hashes(part, starts, ends))
        counts[a:b] = np.bincount(row, minlength=b - a)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def windows(hashes: np.ndarray, counts: np.ndarray, width: int):
    """Start index (into ``hashes``) of every window of ``width`` words within one row."""
    ends = np.cumsum(counts)
    room = np.maximum(counts - width + 1, 0)
    total = int(room.sum())
    rank = np.arange(total) - np.repeat(np.cumsum(room) - room, room)
    return np.repeat(ends - counts, room) + rank, np.repeat(np.arange(len(counts)), room)


def int64s(values) -> np.ndarray:
    """A column of ids as int64; null counts as the largest id."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        return np.zeros(0, np.int64)
    return np.asarray(values.cast(pa.int64()).fill_null(np.iinfo(np.int64).max))


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """True where a sorted array takes a new value."""
    out = np.ones(len(sorted_values), bool)
    out[1:] = sorted_values[1:] != sorted_values[:-1]
    return out


def pack(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
