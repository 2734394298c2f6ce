"""Words of whole UTF-8 texts and 64-bit hashes of words and word sequences, over arrays instead of strings."""

from __future__ import annotations

import numpy as np

#: White space of the word pattern [^\x20\x09-\x0D]+: a fixed value.
WORD_SPACE = np.zeros(256, bool)
WORD_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 18
#: Two families of hashes that share nothing.
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_STEPS = np.uint64(0xD1342543DE82EF95), np.uint64(0x9FB21C651E98DF25)
_powers = {base: (np.ones(1, np.uint64), np.ones(1, np.uint64)) for base in _BASES}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _power(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[base][0]) < n:
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[base] = np.cumprod(up), np.cumprod(down)
    return _powers[base]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and for each of the n + 1 text offsets the number of words before it."""
    solid = ~WORD_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after[inner - 1] = False
    begin, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return begin, end, np.searchsorted(begin, offsets)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """A polynomial hash of each word's bytes, taken from prefix sums over CHUNK bytes (or one longer word) at a time."""
    out, i = np.empty(len(begin), np.uint64), 0
    while i < len(begin):
        at = begin[i]
        j = max(i + 1, int(np.searchsorted(end, at + CHUNK, "right")))
        some = data[at : end[j - 1]]
        up, down = _power(len(some) + 1, _BASES[family])
        sums = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(_BYTE[some] * up[: len(some)], out=sums[1:])
        b, e = begin[i:j] - at, end[i:j] - at
        out[i:j] = mix((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64))
        i = j
    return out


def windows(hashes: np.ndarray, size: int, family: int = 0) -> np.ndarray:
    """Hash of the `size` words from each place on (fewer places than words by size - 1)."""
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * _STEPS[family] + hashes[k : k + n]
    return mix(total + np.uint64(size))


def inside(counts: np.ndarray, size: int) -> np.ndarray:
    """Places of windows that don't leave their text, given the word numbers of the text bounds."""
    n = np.diff(counts)
    room = np.maximum(n - size + 1, 0)
    first = np.repeat(counts[:-1] - (np.cumsum(room) - room), room)
    return first + np.arange(len(first))
