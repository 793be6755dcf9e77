"""Byte-pair encoding by dynamic programming over prefixes, and decoding (operator 12).

A sequence of tokens is what merging yields exactly if every two neighbours, merged together, stay as they are. So each
prefix of a word has one possible last token: of the tokens that end there, the one that stays beside the last token of
the prefix before it. An automaton over the vocabulary lists the tokens that end at each place, a walk along the merges
of two tokens tells whether they stay, and the ids are read off backwards from the end of the word. All new words of a
batch take this way together, place by place.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from assayer.llm.packing import tokenizer_path
from assayer.llm.wordbatch import Recent, laid_out, repeated, slices, split_words

NEVER = 1 << 60
END = 256  # stands, behind the 256 bytes, for the sign of a word's end, which is part of the last byte
LONG = 64  # bytes of a word; longer ones are encoded one by one
TOGETHER = 1 << 14  # words encoded together
SLICE = 1 << 21  # bytes of texts encoded at a time
PAIRS = 1 << 21  # places for remembered tests of pairs of tokens, half of them used at most
KNOWN = 1 << 15  # words of a full generation whose ids are remembered; two generations are
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class SuffixMatches:
    """An automaton over a set of strings: after each sign, the longest string of the set that ends there.

    ``shorter`` leads from a string to the next shorter one that ends with it, so all matches at a place form a chain.
    """

    def __init__(self, strings: dict[tuple[int, ...], int], n: int):
        children: list[dict[int, int]] = [{}]
        ends = {}
        for string, number in strings.items():
            node = 0
            for sign in string:
                following = children[node].get(sign)
                if following is None:
                    following = children[node][sign] = len(children)
                    children.append({})
                node = following
            ends[node] = number
        # Strings that none goes on from share the row of steps of their longest proper suffix that one goes on from.
        inner = [i for i, c in enumerate(children) if c]
        self.row = np.zeros(len(children), np.int32)
        self.row[inner] = np.arange(len(inner))
        self.steps = np.zeros((len(inner), END + 1), np.int32)
        self.longest = np.full(len(children), -1, np.int32)
        self.shorter = np.full(n, -1, np.int32)
        level = [(0, 0)]  # nodes of one depth, each with that of its longest proper suffix
        while level:
            deeper = []
            for node, back in level:
                if node:
                    self.longest[node] = self.longest[back]
                    if children[node]:
                        self.steps[self.row[node]] = self.steps[self.row[back]]
                    else:
                        self.row[node] = self.row[back]
                if node in ends:
                    self.shorter[ends[node]] = self.longest[back]
                    self.longest[node] = ends[node]
                for sign, child in children[node].items():
                    deeper.append((child, int(self.steps[self.row[node], sign]) if node else 0))
                    self.steps[self.row[node], sign] = child
            level = deeper

    def step(self, node, sign):
        """The node after a sign; for numbers or arrays of them."""
        return self.steps[self.row[node], sign]


class PairTests:
    """Remembered answers about pairs of tokens, looked up for many pairs at once."""

    def __init__(self, test, n: int):
        self.test, self.n = test, n
        self._clear()

    def _clear(self) -> None:
        self.keys, self.answers, self.used = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool), 0

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """For each key the place that holds it, or the empty one where the search for it ends."""
        at = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)
        away = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(away):
            at[away] = (at[away] + 1) % PAIRS
            away = away[(self.keys[at[away]] != keys[away]) & (self.keys[at[away]] >= 0)]
        return at

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * self.n + b
        at = self._places(keys)
        new = np.unique(keys[self.keys[at] < 0])
        if not len(new):
            return self.answers[at]
        if self.used + len(new) > PAIRS // 2:
            self._clear()
            new, each = np.unique(keys, return_inverse=True)
        answers = np.array([self.test(*divmod(k, self.n)) for k in new.tolist()], bool)
        if len(new) > PAIRS // 2:  # more than can be remembered
            return answers[each]
        self.used += len(new)
        while len(new):  # of those that go to the same place one is kept, the others look further
            place, first = np.unique(self._places(new), return_index=True)
            self.keys[place], self.answers[place] = new[first], answers[first]
            new, answers = np.delete(new, first), np.delete(answers, first)
        return self.answers[self._places(keys)]


class WordModel:
    """Vocabulary and merges: the ids of words, given as bytes.

    ``merges`` are (left, right) in order of rank, spelled like the vocabulary with a printable letter for each byte.
    ``suffix`` marks tokens that end a word; the last byte of a word carries it from the start.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix, letters = suffix, letter_bytes()

        def signs(token: str) -> tuple[int, ...]:
            ending = bool(suffix) and token.endswith(suffix) and token != suffix
            found = tuple(letters.get(c, -1) for c in (token.removesuffix(suffix) if ending else token))
            return (*found, END) if ending else found

        n = max(vocabulary.values()) + 1
        self.rank = {(vocabulary[a], vocabulary[b]): r for r, (a, b) in enumerate(merges)}
        self.formed, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        usable = {s: i for t, i in vocabulary.items() if len(s := signs(t)) - (s[-1:] == (END,)) == 1 and -1 not in s}
        for r, (a, b) in enumerate(merges):
            x, y = vocabulary[a], vocabulary[b]
            i = vocabulary[a + b]
            if self.formed[i] >= 0:
                continue  # an earlier merge forms it
            self.formed[i], self.left[i], self.right[i] = r, x, y
            # A token that merging its own bytes does not yield is in no encoding.
            if self.formed[x] != NEVER and self.formed[y] != NEVER and self.stay(x, y, r):
                usable[signs(a + b)] = i
            else:
                self.formed[i] = NEVER
        self.size = np.zeros(n, np.int32)
        for s, i in usable.items():
            self.size[i] = len(s)
        self.matches, self.beside = SuffixMatches(usable, n), PairTests(self.stay, n)

    def stay(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether no merge of rank below ``before`` crosses from token ``a`` to ``b``.

        Merges are taken back from the latest on. Two symbols that touch merge if their rank lies below those of the
        merges that take either away; of equal ranks the left one comes first.
        """
        before_a = before_b = before
        while True:
            rank = self.rank.get((a, b), NEVER)
            if rank < before_a and rank <= before_b:
                return False
            formed_a, formed_b = self.formed[a], self.formed[b]
            if formed_a < 0 and formed_b < 0:
                return True
            if formed_a > formed_b:
                before_a, a = formed_a, self.right[a]
            else:
                before_b, b = formed_b, self.left[b]

    def _signs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A row of signs for each word, and how many it has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max(initial=0))
        flat = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8)
        signs = np.zeros((len(words), width + 1), np.int32)
        signs[:, :width] = flat.reshape(len(words), width)
        if self.suffix:
            signs[np.arange(len(words)), sizes] = END
            sizes = sizes + 1
        return signs, sizes

    def last_tokens(self, signs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, start) of the last token of every prefix of every word; -1 where no token can end."""
        found, starts = np.full(signs.shape, -1, np.int32), np.zeros(signs.shape, np.int32)
        node = np.zeros(len(signs), np.int32)
        for end in range(1, int(sizes.max(initial=0)) + 1):
            rows = np.flatnonzero(sizes >= end)
            node[rows] = self.matches.step(node[rows], signs[rows, end - 1])
            token = self.matches.longest[node[rows]]
            while True:
                some = token >= 0
                rows, token = rows[some], token[some]
                if not len(rows):
                    break
                begin = end - self.size[token]
                before = found[rows, begin - 1]  # of the prefix that ends where the token begins
                good = begin == 0
                asked = np.flatnonzero(~good & (before >= 0))
                good[asked] = self.beside(before[asked], token[asked])
                found[rows[good], end - 1], starts[rows[good], end - 1] = token[good], begin[good]
                rows, token = rows[~good], self.matches.shorter[token[~good]]
        return found, starts

    def _together(self, words: list[bytes]) -> list[bytes]:
        signs, sizes = self._signs(words)
        found, starts = self.last_tokens(signs, sizes)
        count, at = np.zeros(len(words), np.int64), sizes.copy()
        out = np.zeros(signs.shape, np.uint32)  # from the last token on
        while len(rows := np.flatnonzero(at)):
            ids = found[rows, at[rows] - 1]
            if (ids < 0).any():
                raise ValueError("the vocabulary does not spell a word")
            out[rows, count[rows]] = ids
            count[rows] += 1
            at[rows] = starts[rows, at[rows] - 1]
        kept = np.arange(signs.shape[1]) < count[:, None]
        order = np.where(kept, count[:, None] - 1 - np.arange(signs.shape[1]), 0)
        flat = np.take_along_axis(out, order, axis=1)[kept].tobytes()
        ends = np.cumsum(count) * 4
        return [flat[b - 4 * n : b] for b, n in zip(ends.tolist(), count.tolist())]

    def _alone(self, word: bytes) -> bytes:
        """A long word: the same search, place after place."""
        signs = [*word, END] if self.suffix else list(word)
        found, starts, node = [-1], [0], 0
        step, longest, shorter, size = self.matches.step, self.matches.longest, self.matches.shorter, self.size
        known: dict[tuple[int, int], bool] = {}
        for end, sign in enumerate(signs, 1):
            node = step(node, sign)
            token, begin = int(longest[node]), 0
            while token >= 0:
                begin = end - int(size[token])
                if not begin:
                    break
                pair = (found[begin], token)
                if pair[0] >= 0:
                    stays = known.get(pair)
                    if stays is None:
                        if len(known) >= PAIRS // 8:
                            known.clear()
                        stays = known[pair] = self.stay(*pair)
                    if stays:
                        break
                token = int(shorter[token])
            found.append(token)
            starts.append(begin)
        at, out = len(signs), []
        while at:
            if found[at] < 0:
                raise ValueError("the vocabulary does not spell a word")
            out.append(found[at])
            at = starts[at]
        return np.array(out[::-1], np.uint32).tobytes()

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as native unsigned 32-bit numbers."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        short = sum(len(w) <= LONG for w in words)
        out = [b""] * len(words)
        for at in range(0, short, TOGETHER):  # words of about one length share a table
            some = order[at : min(at + TOGETHER, short)]
            for i, ids in zip(some, self._together([words[i] for i in some])):
                out[i] = ids
        for i in order[short:]:
            out[i] = self._alone(words[i])
        return out


class Words:
    """Ids of whole texts from those of their space-separated parts, for a tokenizer file with word ends.

    The file's own normaliser and splitter cut a part into words; parts of plain letters with punctuation behind are
    cut here. Strings of special tokens become their ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        model = given["model"]
        if given["decoder"] is not None or given["post_processor"] is not None or model["type"] != "BPE":
            raise ValueError("a byte-pair vocabulary without decoder and post-processor is expected")
        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.letters = letter_bytes()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.model = WordModel(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        names = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.words, self.parts = Recent(KNOWN), Recent(KNOWN)

    def cut(self, part: str) -> list[bytes | int]:
        """The words of a part, and the ids of special tokens in it."""
        if part.isascii():
            low = part.lower()
            stem = low.rstrip(PUNCTUATION)
            if stem.isalpha():
                return [stem.encode(), low[len(stem) :].encode()] if len(stem) < len(low) else [low.encode()]
        else:
            low = part.replace("Σ", "σ").lower()  # letter by letter: the end of a word makes no difference
            stem = low.rstrip(PUNCTUATION)
            if stem.isalpha() and is_normalized("NFC", part):
                return [stem.encode(), low[len(stem) :].encode()] if len(stem) < len(low) else [low.encode()]
        out: list[bytes | int] = []
        for piece in self.between.split(part):
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                out += [bytes([self.letters[c] for c in w]) for w, _ in self.split(self.normal(piece))]
        return out

    def _ids(self, parts: list[str], often: list[bool]) -> list[bytes]:
        out = self.parts.recall(parts)
        new = [i for i, ids in enumerate(out) if ids is None]
        cuts = [self.cut(parts[i]) for i in new]
        words = list({w for cut in cuts for w in cut if w.__class__ is bytes})
        ids = self.words.recall(words)
        fresh = [i for i, found in enumerate(ids) if found is None]
        for i, found in zip(fresh, self.model.encode([words[i] for i in fresh])):
            ids[i] = found
        self.words.keep(words, ids)  # words stand in several parts
        known = dict(zip(words, ids))
        for i, cut in zip(new, cuts):
            out[i] = b"".join([known[w] if w.__class__ is bytes else np.uint32(w).tobytes() for w in cut])
        self.parts.keep(compress(parts, often), compress(out, often))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin and the last's end); null is the empty text."""
        texts = pc.fill_null(texts, "")
        for space in "\n\t":
            texts = pc.replace_substring(texts, space, " ")
        at, ends, parts = split_words(texts)
        return laid_out(self._ids(parts, repeated(at, len(parts))), at, ends)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings, joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


def letter_bytes() -> dict[str, int]:
    """The byte behind each printable letter of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def words(path: str) -> Words:
    found = Words(path)  # one per Python worker, which serves many tasks
    gc.collect()
    gc.freeze()  # the vocabulary is not looked through again
    return found


def _coded(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = words(path)
        for batch in (piece for whole in batches for piece in slices(whole, "text", SLICE)):
            ids, ends = model.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
            columns = {"doc_id": batch.column("doc_id"), "ids": lists}
            if decoded:
                columns["decoded"] = pa.array([model.decode(ids[a:b]) for a, b in zip(ends, ends[1:])], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def encode(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(doc_id, ids) per document, with ``decoded`` also the text that the ids stand for, made in the same pass.

    A null text is encoded like the empty one: no ids. Repeated rows are encoded each, doc_id is carried as it is (null
    too), and other columns are ignored. Time and memory grow with a text's length, whatever it holds; a text fits a
    row. Every row is encoded by itself: no shuffle.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [own.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField("decoded", T.StringType())] * decoded
    return own.mapInArrow(_coded(path or tokenizer_path(), decoded), T.StructType(fields))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The input with ``decoded``, the text that ``ids`` stand for; null ids give null, no ids the empty text."""
    model_path = path or tokenizer_path()
    fields = [f for f in encoded.schema.fields if f.name != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = words(model_path)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            texts = [None if x is None else " ".join(map(model.names.__getitem__, x)) for x in lists]
            kept = {f.name: batch.column(f.name) for f in fields}
            yield pa.RecordBatch.from_pydict(kept | {"decoded": pa.array(texts, pa.string())})

    return encoded.mapInArrow(run, T.StructType([*fields, T.StructField("decoded", T.StringType())]))


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, decoded=True).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
