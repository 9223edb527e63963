"""Words of a batch of UTF-8 texts and their 64-bit hashes, in numpy.

A word is a longest run of bytes other than space and 0x09-0x0D. Hashes are polynomial sums over random byte values,
taken from one running sum per batch, so that a word costs the same whatever its length.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_random = np.random.Generator(np.random.PCG64(20240229))
_RAW = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _RAW.copy()
_LOWER[65:91] = _RAW[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Odd factors of the places in a window.
PLACES = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base of the running sums, and of its inverse."""
    if len(_powers[0]) < n:
        for side, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _powers[side] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def utf8(array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without copying the text; a null is an empty text."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset: array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]: offsets[-1]]


class Words:
    """``start`` and ``end`` are byte positions; the words of text i are those from ``first[i]`` up to ``first[i + 1]``."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.offsets, self.data = offsets, data
        inside = ~WHITE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside[:-1])) if len(data) else inside
        after = np.concatenate((inside[1:], [False])) if len(data) else inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.inside = inside

    def hashes(self, lower: bool) -> np.ndarray:
        """One 64-bit hash per word; with ``lower`` the letters A-Z count as a-z."""
        up, down = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_LOWER if lower else _RAW)[self.data] * up[:-1], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` word hashes, in order; they may run over the end of a text."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    for place in range(size):
        total += hashes[place: len(hashes) - size + 1 + place] * PLACES[place]
    return mix(total, size)
