"""64-bit hashes of all words of many texts at once, as NumPy array work.

A word is a run of ``[^\\x20\\x09-\\x0D]`` bytes, A-Z folded. Its hash is a
polynomial over random letter values, taken from prefix sums over the bytes, so
no Python object is made per word. Equal words hash equally in every task.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes worked through at a time (a longer word is worked through whole).
SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_ODD = np.uint64(BASE)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    power = np.full(n, _ODD, np.uint64)
    inverse = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    return np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


def hash_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """(hash of every word, number of words by text, all texts folded and joined, word starts, word ends)."""
    data = b"\n".join([t or b"" for t in texts]).lower()  # bytes: ASCII only
    raw = np.frombuffer(data, np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1])  # a start and an end in turn
    start, end = edge[0::2].copy(), edge[1::2].copy()
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE, "right")))
        base = start[i]
        part = raw[base:end[j - 1]]
        power, inverse = _powers(max(SLICE, 1 << int(len(part) - 1).bit_length()))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LETTERS[part] * power[:len(part)], out=sums[1:])
        lo, hi = start[i:j] - base, end[i:j] - base
        out[i:j] = mix((sums[hi] - sums[lo]) * inverse[lo] ^ (hi - lo).astype(np.uint64))
        i = j
    sizes = np.array([len(t or b"") for t in texts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    cut = np.append(np.searchsorted(start, begin), len(start))
    return out, np.diff(cut), data, start, end
