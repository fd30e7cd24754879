"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from . import common

#: Words in a shingle, and the similarity that makes near-duplicates.
WORDS, SIMILAR = 5, 0.8
_POWERS = tuple(np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(64))
word_hash = common.Cache(lambda w: xxhash.xxh3_64_intdigest(w) >> 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def windows(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Hashes of the runs of n word hashes; of all words, if there are fewer."""
    n = min(n, len(words))
    if n == 0:
        return np.zeros(0, np.uint64)
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h += words[i : len(words) - n + 1 + i] * _POWERS[i]
    return mixed(h)


_POINT = np.uint64(0xD1B54A32D192ED03)
_BACK = np.uint64(pow(0xD1B54A32D192ED03, -1, 1 << 64))
_ups: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_ups[0]) < n:
        n = 1 << (n - 1).bit_length()
        for i, base in enumerate((_POINT, _BACK)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _ups[i] = np.cumprod(p, dtype=np.uint64)
    return _ups


def words_of(text: str) -> np.ndarray:
    """Hashes of a text's words: what ASCII white space parts, in lower case.

    A word's hash is its bytes' polynomial, taken from the text's running sums.
    """
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    a, b = edge[::2], edge[1::2]
    up, back = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up[: len(data)], out=sums[1:])
    return mixed((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))


def of(text: str) -> np.ndarray:
    """The shingles of a text, in order, with repeats."""
    return windows(words_of(text))
