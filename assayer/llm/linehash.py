"""Polynomial hashes of lines, their halves and their one-deletion variants, for whole batches at once.

A line's hash is the sum of random values of its code points times powers of an odd base, modulo 2**64, so the hash of
a part or of the line without one code point follows from running sums.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_VALUES = mixed(np.arange(1, 0x3001))  # of the first code points


class Lines:
    """Running sums over a batch of lines."""

    def __init__(self, lines: list[str]):
        self.size = np.fromiter(map(len, lines), np.int64, len(lines))
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        longest = int(self.size.max(initial=0)) + 2
        self.up, self.down = _powers(BASE, longest), _powers(INVERSE, longest)
        self.place = np.arange(len(points)) - np.repeat(self.start, self.size)
        value = _VALUES[np.minimum(points, 0x2FFF)]
        rare = points >= 0x3000
        if rare.any():
            value[rare] = mixed(points[rare].astype(np.uint64) + np.uint64(0x10001))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * self.up[self.place])])

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.sums[b] - self.sums[a]

    def whole(self) -> np.ndarray:
        return self._between(self.start, self.end)

    def halves(self) -> list[np.ndarray]:
        """Four keys a line: its first and last half as a line of its own length and as one of a code point less.

        Lines within one edit share a key: of the shorter's length q, the first or the last floor(q / 2) are equal.
        """
        keys = []
        for q in (self.size, self.size - 1):
            half = np.maximum(q, 0) // 2
            first = self._between(self.start, self.start + half)
            last = self._between(self.end - half, self.end) * self.down[self.size - half]
            keys += [mixed(part ^ mixed(q.astype(np.uint64) * np.uint64(2) + np.uint64(kind))) for kind, part in enumerate((first, last))]
        return keys

    def without(self) -> tuple[np.ndarray, np.ndarray]:
        """For every code point of every line: the line's number and the hash of the line without it."""
        line = np.repeat(np.arange(len(self.size)), self.size)
        at = self.start[line] + self.place
        before = self.sums[at] - self.sums[self.start[line]]
        after = self.sums[self.end[line]] - self.sums[at + 1]
        return line, before + after * np.uint64(INVERSE)


def name(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The final hash of a line of a given length."""
    return mixed(hashes ^ mixed(size.astype(np.uint64) + np.uint64(0x5851F42D)))
