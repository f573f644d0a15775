"""Vectorised word splitting and hashing over UTF-8 bytes, used inside tasks.

A word's hash is a polynomial in its bytes' random 64-bit codes modulo 2^64, taken from prefix sums over the
whole text, then mixed: a whole text costs a few array operations, however many words it has. The same sums
give the hash of any prefix of any word.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODE = np.random.default_rng(20240607).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

#: ASCII white space: space and \t to \r.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Everything in ASCII but letters and digits.
NON_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                globals()[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(30)
    return h


class Text:
    """The words of one text: `starts` and `ends` in its bytes and `hashes`."""

    def __init__(self, data: bytes, separators: np.ndarray = SPACE):
        self.bytes = np.frombuffer(data, np.uint8)
        n = len(self.bytes)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = ~separators[self.bytes]
        edge = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self._sums = np.zeros(n + 1, np.uint64)
        powers, self._inverse = _tables(n + 1)
        np.cumsum(_CODE[self.bytes] * powers[:n], out=self._sums[1:])
        self.hashes = self.between(self.starts, self.ends)

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts])

    def prefixes(self, size: int) -> np.ndarray:
        """Hashes of the words' first `size` bytes (the whole word, salted alike, where it is shorter)."""
        return self.between(self.starts, np.minimum(self.starts + size, self.ends)) ^ np.uint64(0x5851F42D4C957F2D + size)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` consecutive words."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    n = len(hashes) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[i : i + n]
    return mix(out)
