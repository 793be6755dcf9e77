"""Token ids of texts from the cached ids of their parts."""

from __future__ import annotations

import numpy as np

CACHED_PARTS = 250_000


class _Places(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class PartCache:
    """Splits texts into parts whose ids do not depend on their neighbours, and encodes each new part once.

    Subclasses say how to split and encode. The cache starts anew when it is full.
    """

    def __init__(self):
        self._reset()

    def _reset(self) -> None:
        self.places = _Places()
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def split(self, text: str) -> list[str]:
        raise NotImplementedError

    def ids_of(self, parts: list[str]) -> list[bytes]:
        """Native unsigned 32-bit ids of each part."""
        raise NotImplementedError

    def _learn(self) -> None:
        parts, self.places.new = self.places.new, []
        out = self.ids_of(parts)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(out), np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) // 4 for x in out], dtype=np.int64)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.places) > CACHED_PARTS:
            self._reset()
        number, at = self.places.__getitem__, []
        for text in texts:
            parts = self.split(text)
            at.append(np.fromiter(map(number, parts), np.int32, len(parts)))
        if self.places.new:
            self._learn()
        return [self._gathered(x) for x in at]

    def _gathered(self, at: np.ndarray) -> np.ndarray:
        start = self.ends[at]
        size = self.ends[at + 1] - start
        stop = np.cumsum(size)
        if not len(at):
            return np.zeros(0, np.uint32)
        return self.ids[np.repeat(start - stop + size, size) + np.arange(stop[-1])]
