"""Byte-pair encoding of one chunk of a text, its transfer matrix and its backtrace.

The model merges pairs by score, and no piece has a space sign behind another sign or holds a line break. Its encoding
of a text is the one sequence of pieces in which every two neighbours, encoded together, stay as they are. So it is
the one path of finite weight in a graph of pieces whose edges weigh 0 between such neighbours and minus infinity
else, and chunks of it combine like matrices over (max, +). A row of such a matrix is kept as the bits of its zeros.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACE = "▁"
LEAD = "\n"  # encoded by its byte, so nothing merges with it; keeps the model's own leading space away
FREE = None  # the state at a cut that no piece can cross


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def spelled(text: str) -> str:
    """The signs that the model encodes; an empty text has none."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def breaks(a: str, b: str) -> bool:
    """Whether no piece holds both of two neighbouring signs."""
    return a == "\n" or b == "\n" or (b == SPACE and a != SPACE)


class Pieces:
    """The model and its vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, n = self.model, self.model.vocab_size()
        special = lambda i: m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)
        self.known = {m.id_to_piece(i): i for i in range(n) if not special(i)}
        self.bytes = {b: m.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.longest = max(map(len, self.known))
        self.stay = lru_cache(1 << 16)(self._stay)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return np.array(self.model.encode(text, out_type=int), np.int32)

    def token_ids(self, token: str) -> list[int]:
        known = self.known.get(token)
        return [known] if known is not None else [self.bytes[b] for b in token.encode()]

    def _stay(self, a: str, b: str) -> bool:
        """Whether two tokens, encoded together, stay as they are."""
        if a not in self.known or b not in self.known or breaks(a[-1], b[0]):
            return True
        return self.model.encode(LEAD + a + b, out_type=int)[2:] == [self.known[a], self.known[b]]

    def starting(self, text: str, at: int) -> list[int]:
        """Ends of the tokens that can begin at a place: pieces, and single signs without one."""
        ends = [e for e in range(at + 1, min(len(text), at + self.longest) + 1) if text[at:e] in self.known]
        return ends if text[at] in self.known else [at + 1, *ends]

    def states(self, text: str, cut: int) -> list[tuple[int, int] | None]:
        """What can stand at a cut: the token that ends there or crosses it, or FREE alone."""
        if cut <= 0 or cut >= len(text) or breaks(text[cut - 1], text[cut]):
            return [FREE]
        return [(s, e) for s in range(max(0, cut - self.longest), cut) for e in self.starting(text, s) if e >= cut]

    def _walk(self, text: str, entries: list[tuple[int, int] | None], start: int, stop: int) -> dict[int, list]:
        """By end, the (start, entries from which it is reached) of all tokens that begin before ``stop``."""
        ends: dict[int, list] = {}
        for j, state in enumerate(entries):
            at, s = (start, None) if state is FREE else (state[1], state[0])
            ends.setdefault(at, []).append((s, 1 << j))
        for at in range(start, stop):
            before = ends.get(at)
            if not before:
                continue
            for e in self.starting(text, at):
                token, mask = text[at:e], 0
                for s, from_ in before:
                    if s is None or self.stay(text[s:at], token):
                        mask |= from_
                if mask:
                    ends.setdefault(e, []).append((at, mask))
        return ends

    def transfer(self, text: str, start: int, stop: int) -> tuple[int, list[int]]:
        """(number of entry states, for each exit state the bits of the entry states that lead to it)."""
        entries, exits = self.states(text, start), self.states(text, stop)
        if entries == exits == [FREE]:
            return 1, [1]
        ends = self._walk(text, entries, start, stop)
        reached = lambda x: [m for s, m in ends.get(stop if x is FREE else x[1], []) if x is FREE or s == x[0]]
        return len(entries), [int(np.bitwise_or.reduce(np.array(reached(x) or [0], object))) for x in exits]

    def traced(self, text: str, start: int, stop: int, entry: int, exit_: int) -> list[int]:
        """Ids of the tokens after the entry state's, up to the exit state's own."""
        first, last = self.states(text, start)[entry], self.states(text, stop)[exit_]
        if first is FREE and last is FREE:
            return self.model.encode(LEAD + text[start:stop], out_type=int)[2:]
        ends = self._walk(text, [first], start, stop)
        begin = start if first is FREE else first[1]
        at, tokens = (stop, None) if last is FREE else (last[1], last[0])
        token_start = tokens if tokens is not None else ends[at][0][0]
        path: list[str] = []
        while at > begin:
            path.append(text[token_start:at])
            token, at = text[token_start:at], token_start
            if at <= begin:
                break
            token_start = next(s for s, _ in ends[at] if s is None or self.stay(text[s:at], token))
        return [i for t in reversed(path) for i in self.token_ids(t)]


def combined(left: tuple[int, list[int]], right: tuple[int, list[int]]) -> tuple[int, list[int]]:
    """The product of two transfer matrices; it is associative."""
    columns = []
    for through in right[1]:
        mask = 0
        for j, m in enumerate(left[1]):
            if through >> j & 1:
                mask |= m
        columns.append(mask)
    return left[0], columns


def cut_states(matrices: list[tuple[int, list[int]]]) -> list[int]:
    """The state of the path at every cut, from products of the chunks before and behind it."""
    before, after = [], [0] * len(matrices)
    product = None
    for m in matrices:
        product = m if product is None else combined(product, m)
        before.append(sum(1 << j for j, mask in enumerate(product[1]) if mask & 1))
    product = None
    for k in range(len(matrices) - 1, -1, -1):
        product = matrices[k] if product is None else combined(matrices[k], product)
        after[k] = product[1][0]
    found = [0]
    for k in range(1, len(matrices)):
        both = before[k - 1] & after[k]
        found.append((both & -both).bit_length() - 1)
    return [*found, 0]


@lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)  # one per Python worker
