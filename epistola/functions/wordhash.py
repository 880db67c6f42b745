"""Vectorised tokenising: the words of a batch of texts as 64-bit hashes, without a Python loop over words.

A word is a longest run of letters and digits of the lower-cased text. Texts of a batch are joined and handled as one byte
array; the hash of a word is multilinear in its bytes (random odd multipliers by position), mixed once more at the end.
"""

from __future__ import annotations

import numpy as np

_POSITIONS = 256
_R = (np.random.default_rng(20240501).integers(0, 2**63, size=_POSITIONS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class _Separators(dict):
    """A translation table that turns every non-ASCII character that is no letter or digit into a space, found on first use."""

    def __missing__(self, code: int):
        self[code] = code if code < 128 or chr(code).isalnum() else 32
        return self[code]


_SEPARATORS = _Separators()


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _GOLD
    return h ^ (h >> np.uint64(29))


def normalise(text: str | None) -> str:
    """Lower case, with every non-ASCII separator as a space."""
    if not text:
        return ""
    low = text.lower()
    return low if low.isascii() else low.translate(_SEPARATORS)


def hash_words(texts) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, pointers): the words of text i are ``hashes[pointers[i]:pointers[i + 1]]``. Null counts as empty."""
    parts = [normalise(t).encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    raw = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
    inside = _WORD[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, stop = edge[::2], edge[1::2]
    pointers = np.searchsorted(start, np.concatenate(([0], np.cumsum(lengths))))
    if not len(start):
        return np.zeros(0, np.uint64), pointers
    size = stop - start
    at = np.flatnonzero(inside)
    first = np.cumsum(size) - size
    position = np.arange(len(at)) - np.repeat(first, size)
    terms = raw[at].astype(np.uint64) * _R[position % _POSITIONS]
    return mix(np.add.reduceat(terms, first) + size.astype(np.uint64) * _GOLD), pointers


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n consecutive words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += words[k : k + m] * _R[k + 7]
    return mix(out)
