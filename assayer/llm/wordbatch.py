"""Distinct words of a batch of texts, and what is known of each, laid out over the texts again."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Recent:
    """Remembers what was found for keys: two generations, of which one ends when it holds ``size`` keys or more.

    Batches come whole, so a generation holds fewer keys than ``size`` and one batch's.
    """

    def __init__(self, size: int):
        self.size, self.now, self.before = size, {}, {}

    def recall(self, keys: Sequence[Hashable]) -> list:
        """What is known of each key, else None."""
        before = self.before.get
        return [before(k) if found is None else found for k, found in zip(keys, map(self.now.get, keys))]

    def keep(self, keys: Iterable[Hashable], found: Iterable) -> None:
        if len(self.now) >= self.size:
            self.now, self.before = {}, self.now
        self.now.update(zip(keys, found))


def slices(batch: pa.RecordBatch, column: str, held: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with up to ``held`` bytes in a text column each; a longer text is alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = int(size[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + held, "right")))
        yield batch.slice(at, end - at)
        at = end


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(number of each part, place in it where each text begins and the last ends, distinct parts) at single spaces."""
    lists = pc.split_pattern(texts, " ")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    coded = lists.flatten().dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
    return coded.indices.to_numpy(zero_copy_only=False), ends, coded.dictionary.to_pylist()


def repeated(at: np.ndarray, n: int) -> list[bool]:
    """Whether each of ``n`` parts stands at two places or more; others are not worth remembering."""
    return (np.bincount(at, minlength=n) > 1).tolist()


def spread(values: np.ndarray, size: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of all texts in a row, where each text's begin and the last's end).

    ``values`` holds ``size`` values of each part in turn, ``at`` the parts of all texts, ``ends`` where in it each text
    begins and the last ends.
    """
    start = np.cumsum(size) - size
    length = size[at]
    stop = np.cumsum(length)
    total = int(stop[-1]) if len(stop) else 0
    flat = values[np.repeat(start[at] - stop + length, length) + np.arange(total)]
    return flat, np.concatenate([[0], stop])[ends]


def laid_out(parts: list[bytes], at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`spread` for parts whose values are given as bytes of native unsigned 32-bit numbers."""
    return spread(np.frombuffer(b"".join(parts), np.uint32), np.fromiter(map(len, parts), np.int64, len(parts)) // 4, at, ends)
