"""Hashed word shingles of whole Arrow batches, computed with numpy.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z in lower
case. Both rules concern ASCII bytes alone, so they hold on UTF-8 as they do
on characters. A shingle's hash mixes its words' 64-bit hashes in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
#: Random odd values for bytes, places in a word and places in a shingle.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 borders between them."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = texts.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    ends = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def words(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and how many words precede each border."""
    inside = ~_SPACE[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[borders] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | border[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | border[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, borders)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(first, sizes)
    power = np.cumprod(np.full(int(sizes.max()), _STEP | np.uint64(1)))
    value = _BYTE[raw[place + np.repeat(starts, sizes)]] * power[place]
    return mix(np.add.reduceat(value, first) + sizes.astype(np.uint64))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles.

    A text of fewer words is one shingle; one without words has none.
    """
    raw, borders = buffer(texts)
    starts, ends, at = words(raw, borders)
    hashes = word_hashes(raw, starts, ends)
    n = len(hashes)
    whole = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        whole += hashes[i : i + len(whole)] * _PLACE[i]
    whole = mix(whole)
    sets = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            sets.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            short = (hashes[a:b] * _PLACE[k : k + b - a]).sum(dtype=np.uint64)
            sets.append(mix(np.array([short], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
