"""Vectorised word hashing and shingle sets (numpy, inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BYTES_AT_ONCE = 4 << 20


def _generator(seed: int) -> np.random.Generator:
    return np.random.default_rng(seed)


_BYTE = _generator(11).integers(1, 2**63, 256, dtype=U64) | U64(1)
_BASE, _SECOND, _THIRD, _ONE = _generator(12).integers(1, 2**63, 4, dtype=U64) | U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def slices(array: pa.Array, limit: int = BYTES_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row comes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop


def _bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array without nulls, and the row offsets."""
    array = array.cast(pa.large_binary())
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased) in order, and the row offsets."""
    data, rows = _bytes(array)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = rows[:-1][np.diff(rows) > 0]
    begins[inner] = ~space[inner]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(rows), np.int64)
    spans = np.diff(starts, append=len(data))
    head = starts[0]
    place = np.arange(head, len(data)) - np.repeat(starts, spans)
    powers = np.cumprod(np.concatenate([[U64(1)], np.full(int(spans.max()), _BASE, U64)]))
    value = _BYTE[_LOWER[data[head:]]] * powers[place]
    value[space[head:]] = 0
    return mix(np.add.reduceat(value, starts - head)), np.searchsorted(starts, rows)


def shingle_sets(array: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, and the row offsets.

    A shingle is ``size`` consecutive words; a row of fewer words is one
    shingle; a row without words has none.
    """
    words, rows = word_hashes(array)
    multipliers = _generator(13).integers(1, 2**63, size, dtype=U64) | U64(1)
    usual = np.zeros(max(0, len(words) - size + 1), U64)
    for i in range(size):
        usual += words[i : i + len(usual)] * multipliers[i]
    usual = mix(usual)
    sets = []
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if b - a >= size:
            sets.append(np.unique(usual[a : b - size + 1]))
        elif b > a:
            n = int(b - a)
            short = (words[a:b] * multipliers[:n]).sum(dtype=U64, keepdims=True)
            sets.append(mix(short + np.array([n], U64) * _ONE))
        else:
            sets.append(np.zeros(0, U64))
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), offsets


def set_digests(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of every set (0 for an empty one)."""
    out = []
    filled = np.diff(offsets) > 0
    for multiplier in (_SECOND, _THIRD):
        digest = np.zeros(len(offsets) - 1, U64)
        if filled.any():
            digest[filled] = np.add.reduceat(mix(values * multiplier), offsets[:-1][filled])
        out.append(digest.view(np.int64))
    return out[0], out[1]


def minima(values: np.ndarray, offsets: np.ndarray, hashes: int) -> np.ndarray:
    """Minimum of every universal hash (multiply-shift) over every set: one
    uint32 row per set; the largest value for an empty set."""
    g = _generator(14)
    a = g.integers(1, 2**63, hashes, dtype=U64) * U64(2) + U64(1)
    b = g.integers(0, 2**63, hashes, dtype=U64)
    out = np.full((len(offsets) - 1, hashes), 0xFFFFFFFF, np.uint32)
    sizes = np.diff(offsets)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 16384, side="right")) - 1)
        filled = np.flatnonzero(sizes[at:stop]) + at
        if len(filled):
            part = values[offsets[at] : offsets[stop]]
            starts = offsets[filled] - offsets[at]
            for h in range(hashes):
                out[filled, h] = np.minimum.reduceat(part * a[h] + b[h], starts) >> U64(32)
        at = stop
    return out
