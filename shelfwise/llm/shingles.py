"""Word and shingle hashes of text batches, vectorised with numpy."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
SLICE = 2 << 20
PIECE = 4 << 20
GAP = np.zeros(256, bool)
GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUE = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE, _MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
_powers = np.ones(1, np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    h ^= h >> np.uint64(29)
    h = h * _STEP
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    """Powers 0..n of the base modulo 2^64, kept for later calls."""
    global _powers
    if len(_powers) <= n:
        grown = np.full(max(n + 1, SLICE + 1), BASE, np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array, nulls as empty."""
    wide = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = wide.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8)
    data = wide.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: int = 1, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of text, one row at least."""
    _, offsets = buffers(batch.column(column))
    a = 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit)))
        yield batch.slice(a, b - a)
        a = b


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all texts begin and end, in order."""
    gap = GAP[data]
    filled = np.diff(offsets) > 0
    first = ~gap
    first[1:] &= gap[:-1]
    begins = offsets[:-1][filled]
    first[begins] = ~gap[begins]
    last = ~gap
    last[:-1] &= gap[1:]
    ends = offsets[1:][filled] - 1
    last[ends] = ~gap[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the text number of each. Works through slices of bounded size."""
    starts, stops = word_places(data, offsets)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        begin = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, begin + SLICE)))
        piece = data[begin:stops[to - 1]]
        if lower:
            piece = LOWER[piece]
        power = powers(len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(VALUE[piece] * power[:len(piece)], out=sums[1:])
        s, e = starts[at:to] - begin, stops[at:to] - begin
        # brought to a common power, so that a word's hash does not depend on its place
        out[at:to] = (sums[e] - sums[s]) * power[len(piece) - s] * inverse(len(piece)) + (e - s).astype(np.uint64)
        at = to
    return mix64(out), np.searchsorted(offsets, starts, "right") - 1


def inverse(n: int) -> np.uint64:
    return np.uint64(pow(pow(int(BASE), n, 2**64), -1, 2**64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles: one for the whole text if it is shorter, none without words."""
    hashes, text = word_hashes(data, offsets)
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    rolled = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = rolled * BASE + hashes[k:k + len(rolled)]
    rolled = mix64(rolled)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            yield np.unique(rolled[a:b - width + 1])
        elif b > a:
            h = np.uint64(b - a)
            for x in hashes[a:b]:
                h = np.uint64((int(h) * int(BASE) + int(x)) % 2**64)
            yield mix64(np.array([h ^ np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
