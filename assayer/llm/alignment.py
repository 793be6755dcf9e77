"""Alignment of two tokenizers' tokens over the same text, and how often their tokens end together (operator 11).

Both tokenizers cut a text's bytes. Where tokens of both end, the text falls into groups. They are found by divide and
conquer: of an interval the end near its middle that bisection finds in the other tokenizer's ends becomes a cut, both
halves follow in turn, and an interval without one is a group. All intervals of a batch are halved together.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from assayer.llm.bpe import letter_bytes
from assayer.llm.tables import written
from assayer.llm.wordbatch import Recent, repeated, slices, split_words, spread

SPACE = "▁"
STEPS = 4  # ends tried one by one on both sides of the middle, before all others are tried at once
SLICE = 1 << 21  # bytes of texts aligned at a time, a block
TOGETHER = 1 << 14  # code points of short texts encoded in one call
KNOWN = 1 << 15  # parts of a full generation that are remembered; two generations are
# Signs beside which a space may not part the pieces of a text: white space of any kind, marks without width, the space sign.
_ODD = r"[\x00-\x20\x7f-\xa0\x{ad}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}\x{2581}]"
UNSAFE = f"(^ )|( $)|( {_ODD})|({_ODD} )"


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in A, places in B) of the tokens that end together, in order.

    ``ends_a`` and ``ends_b`` rise; text i has the tokens from ``starts_a[i]`` up to ``starts_a[i + 1]``, likewise in B,
    and both last tokens of a text end together. An interval is a run of tokens of both that is known to end together.
    """
    a0, a1, b0, b1 = (x.astype(np.int64) for x in (starts_a[:-1], starts_a[1:], starts_b[:-1], starts_b[1:]))
    some = a1 > a0
    a0, a1, b0, b1 = a0[some], a1[some], b0[some], b1[some]
    done_a, done_b = [], []
    while len(a0):
        cut_a, cut_b = _middle_cuts(ends_a, ends_b, a0, a1, b0, b1)
        whole = cut_a < 0
        done_a.append(a1[whole] - 1)
        done_b.append(b1[whole] - 1)
        a0, a1, b0, b1, cut_a, cut_b = (x[~whole] for x in (a0, a1, b0, b1, cut_a, cut_b))
        a0, a1 = np.concatenate([a0, cut_a + 1]), np.concatenate([cut_a + 1, a1])
        b0, b1 = np.concatenate([b0, cut_b + 1]), np.concatenate([cut_b + 1, b1])
    if not done_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found_a, found_b = np.concatenate(done_a), np.concatenate(done_b)
    order = np.argsort(found_a)
    return found_a[order], found_b[order]


def _found(ends_b: np.ndarray, end: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether an end is one of B's inner ends in [b0, b1), its place), by bisection."""
    at = np.searchsorted(ends_b, end)
    return (at >= b0) & (at < b1 - 1) & (ends_b[np.minimum(at, len(ends_b) - 1)] == end), at


def _middle_cuts(ends_a, ends_b, a0, a1, b0, b1) -> tuple[np.ndarray, np.ndarray]:
    """For each interval the inner common end nearest to the middle of its A tokens as (place in A, in B), or -1."""
    cut_a, cut_b = np.full(len(a0), -1, np.int64), np.full(len(a0), -1, np.int64)
    open_ = np.flatnonzero((a1 - a0 > 1) & (b1 - b0 > 1))
    middle = (a0 + a1 - 1) // 2
    for away in [0, *(sign * d for d in range(1, STEPS + 1) for sign in (1, -1))]:
        if not len(open_):
            return cut_a, cut_b
        at = middle[open_] + away
        inside = (at >= a0[open_]) & (at < a1[open_] - 1)
        rows, at = open_[inside], at[inside]
        hit, place = _found(ends_b, ends_a[at], b0[rows], b1[rows])
        cut_a[rows[hit]], cut_b[rows[hit]] = at[hit], place[hit]
        open_ = open_[cut_a[open_] < 0]
    open_ = open_[a1[open_] - a0[open_] > 2]
    if len(open_):  # the ends further off, all of them
        size = a1[open_] - 1 - a0[open_]
        row = np.repeat(open_, size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + a0[row]
        hit, place = _found(ends_b, ends_a[at], b0[row], b1[row])
        row, at, place = row[hit], at[hit], place[hit]
        order = np.lexsort((np.abs(at - middle[row]), row))
        row, first = np.unique(row[order], return_index=True)
        cut_a[row], cut_b[row] = at[order][first], place[order][first]
    return cut_a, cut_b


# What is known of a piece of text that neither tokenizer's tokens leave: how many tokens of A and of B it has, the pairs
# of last tokens of its groups (id in A times 2**32 plus id in B, native 64-bit), its groups as text, and whether the
# tokens of both spell a space and the text.
Part = tuple[int, int, bytes, str, bool]


class Aligner:
    """Groups of texts under a byte-level vocabulary (A) and a piece model (B).

    A space between two visible signs begins a token in both, so it is a cut that needs no search: what stands between
    two such spaces is encoded, halved and remembered by itself. Texts with other spaces are taken whole.
    """

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = letter_bytes()
        self.n_a, self.n_b = self.a.get_vocab_size(), self.b.vocab_size()
        self.bytes_a = [bytes(letters.get(c, 63) for c in self.a.id_to_token(i) or "") for i in range(self.n_a)]
        self.bytes_b = [self._piece(i) for i in range(self.n_b)]
        if any(SPACE in self.b.id_to_piece(i).lstrip(SPACE) for i in range(self.n_b)):
            raise ValueError("the piece model has a space sign behind another sign")
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # Ids as they stand in the groups: within the A side, at its end, within the B side, at its end.
        marked = [(self.n_a, ","), (self.n_a, "|"), (self.n_b, ","), (self.n_b, ";")]
        self.marked = np.array([f"{i}{mark}" for n, mark in marked for i in range(n)], object)
        self.known = Recent(KNOWN)

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return self.b.id_to_piece(i).replace(SPACE, " ").encode()

    def _ids(self, text: str) -> tuple[list[int], list[int], bool]:
        a, b = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)
        wanted = b" " + text.encode()
        return a, b, b"".join([self.bytes_a[i] for i in a]) == wanted == b"".join([self.bytes_b[i] for i in b])

    def parts(self, texts: list[str], together: int = TOGETHER) -> list[Part]:
        """What is to be known of texts, none of them empty.

        Texts that begin and end with visible signs are encoded in one call as long as they have up to ``together`` code
        points; both tokenizers part them at the spaces between.
        """
        size = np.array(pc.binary_length(pa.array(texts, pa.string())), np.int64) + 1  # with the space before
        runs = np.flatnonzero(np.diff(np.cumsum(size) // max(together, 1), prepend=-1)).tolist() if together else range(len(texts))
        ids_a, ids_b, wrong = [], [], set()
        for run in zip(runs, [*runs[1:], len(texts)]):
            todo = [run]
            while todo:
                start, stop = todo.pop()
                a, b, good = self._ids(" ".join(texts[start:stop]))
                if good:
                    ids_a.append(np.array(a, np.int64))
                    ids_b.append(np.array(b, np.int64))
                elif stop - start > 1:  # find the one that is not spelled
                    middle = (start + stop) // 2
                    todo += [(middle, stop), (start, middle)]
                else:
                    wrong.add(start)
        size[list(wrong)] = 0
        bounds = np.cumsum(size)
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        starts_a, starts_b = (np.concatenate([[0], np.searchsorted(e, bounds, "right")]) for e in (ends_a, ends_b))
        cut_a, cut_b = common_ends(ends_a, ends_b, starts_a, starts_b)
        starts = np.searchsorted(cut_a, starts_a)
        pairs = (a[cut_a] << 32 | b[cut_b]).tobytes()
        spelled, stops = self._spelled(a, b, cut_a, cut_b)
        places, marks = (8 * starts).tolist(), stops[starts].tolist()
        return list(zip(
            np.diff(starts_a).tolist(),
            np.diff(starts_b).tolist(),
            [pairs[x:y] for x, y in zip(places, places[1:])],
            ["".join(spelled[x:y])[:-1] for x, y in zip(marks, marks[1:])],
            [k not in wrong for k in range(len(texts))] if wrong else repeat(True),
        ))

    def _spelled(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(marked ids of all groups in order, where in them each group begins and the last ends)."""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cut_a], last_b[cut_b] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        size_a, size_b = np.bincount(group_a, minlength=len(cut_a)), np.bincount(group_b, minlength=len(cut_a))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]] = a + self.n_a * last_a
        order[np.arange(len(b)) + np.cumsum(size_a)[group_b]] = b + 2 * self.n_a + self.n_b * last_b
        return self.marked[order].tolist(), np.concatenate([[0], np.cumsum(size_a + size_b)])

    def _recalled(self, parts: list[str], often: list[bool]) -> list[Part]:
        out = self.known.recall(parts)
        new = [i for i, found in enumerate(out) if found is None]
        for i, found in zip(new, self.parts([parts[i] for i in new])):
            out[i] = found
        self.known.keep(compress(parts, often), compress(out, often))
        return out

    def align(self, texts: pa.Array) -> "Aligned":
        some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
        odd = pc.fill_null(pc.match_substring_regex(texts, UNSAFE), False).to_numpy(zero_copy_only=False) & some
        even = some & ~odd
        at, ends, words = split_words(texts.filter(pa.array(even)))
        found = self._recalled(words, repeated(at, len(words)))
        found += self.parts(texts.filter(pa.array(odd)).to_pylist(), 0)
        # Texts as runs of parts; odd ones are a part each, behind the words.
        first, size = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        first[even], size[even] = ends[:-1], np.diff(ends)
        first[odd], size[odd] = len(at) + np.arange(odd.sum()), 1
        runs = np.concatenate([at.astype(np.int64), np.arange(len(words), len(found))])
        stops = np.concatenate([[0], np.cumsum(size)])
        runs = runs[np.repeat(first - stops[:-1], size) + np.arange(stops[-1])]
        n_a, n_b, pairs, strings, spelled = zip(*found) if found else ((),) * 5
        # A text that holds a part which its tokens do not spell has none.
        wrong = np.concatenate([[0], np.cumsum(~np.array(spelled, bool)[runs])])[stops]
        bad = np.diff(wrong) > 0
        runs, size = runs[~np.repeat(bad, size)], np.where(bad, 0, size)
        stops = np.concatenate([[0], np.cumsum(size)])
        total = lambda values: np.diff(np.concatenate([[0], np.cumsum(np.array(values, np.int64)[runs])])[stops])
        groups = [";".join([strings[k] for k in runs[s:e].tolist()]) for s, e in zip(stops.tolist(), stops[1:].tolist())]
        counts = np.fromiter(map(len, pairs), np.int64, len(pairs)) // 8
        distinct, place = np.unique(np.frombuffer(b"".join(pairs), np.int64), return_inverse=True)
        links, bounds = spread(place.astype(np.int32), counts, runs, stops)
        return Aligned(total(n_a), total(n_b), groups, links, bounds, distinct)


class Aligned(NamedTuple):
    """A batch: per text numbers of tokens and groups; ``links`` (from ``bounds`` on) are places in ``pairs``."""

    n_a: np.ndarray
    n_b: np.ndarray
    groups: list[str]
    links: np.ndarray
    bounds: np.ndarray
    pairs: np.ndarray


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    found = Aligner(path_a, path_b)  # one per Python worker, which serves many tasks
    gc.collect()
    gc.freeze()  # the vocabularies are not looked through again
    return found


def path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


_BLOCK = "block long, at long, doc_id long, n_a long, n_b long, n_groups long, groups string, links array<int>, pairs array<bigint>, times array<bigint>"


def _aligned(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(piece for whole in batches for piece in slices(whole, "text", SLICE)):
            found, n = both.align(batch.column("text")), batch.num_rows
            links = pa.ListArray.from_arrays(pa.array(found.bounds, pa.int32()), pa.array(found.links))
            none = pa.nulls(n, pa.list_(pa.int64()))
            rows = [pa.array(np.full(n, task + number)), pa.array(np.arange(n)), batch.column("doc_id")]
            rows += [pa.array(x) for x in (found.n_a, found.n_b, np.diff(found.bounds))]
            rows += [pa.array(found.groups, pa.string()), links, none, none]
            schema = pa.schema([(name, x.type) for name, x in zip(_NAMES, rows)])
            yield pa.RecordBatch.from_arrays(rows, schema=schema)
            # One row more: the block's linked pairs and how often each is linked in it.
            times = np.bincount(found.links, minlength=len(found.pairs))
            table = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (found.pairs, times)]
            empty = [pa.nulls(1, f.type) for f in list(schema)[1:-2]]
            yield pa.RecordBatch.from_arrays([pa.array([task + number]), *empty, *table], schema=schema)

    return run


_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document its groups, and per block of documents the pairs of tokens linked in it; written.

    Rows with ``groups`` are documents: doc_id, numbers of tokens and groups, ``groups`` as ``a1,a2|b1;a3|b2,b3`` (ids
    of A, ids of B, in order) and ``links``, the places of the groups' linked pairs (both last tokens) in the block's
    ``pairs``. Rows with ``pairs`` (id in A times 2**32, plus id in B) and ``times`` belong to a block. A block is some
    2 MB of texts.

    Null and empty texts, and texts that the tokens of A or B do not spell, have no tokens. Repeated rows are aligned
    each; doc_id is carried as it is; other columns are ignored. A text fits a row.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T._parse_datatype_string(_BLOCK)
    schema["doc_id"].dataType = own.schema["doc_id"].dataType
    run = _aligned(path_a or path("byte_bpe_50k.json"), path_b or path("piece_bpe_32k.model"))
    return written(own.mapInArrow(run, schema), "aligned")


def group_arrays(alignment: DataFrame) -> DataFrame:
    """(doc_id, groups) with ``groups`` as an array of (a, b), both arrays of ids."""
    ids = lambda text: F.split(text, ",").cast("array<int>")
    pair = lambda g: F.struct(ids(F.split_part(g, F.lit("|"), F.lit(1))).alias("a"), ids(F.split_part(g, F.lit("|"), F.lit(2))).alias("b"))
    none = F.lit(None).cast("array<struct<a:array<int>,b:array<int>>>")
    found = F.when(F.col("groups") != "", F.transform(F.split("groups", ";"), pair)).otherwise(F.coalesce(none, F.array()))
    return alignment.where("groups is not null").select("doc_id", found.alias("groups"))


def pair_counts(alignment: DataFrame) -> DataFrame:
    """(pair, links, best): how many links of all documents hold a pair, and whether its B id has none more frequent.

    Links are added up by block before they are shuffled.
    """
    each = alignment.where("pairs is not null").select(F.inline(F.arrays_zip("pairs", "times"))).where("times > 0")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("links"))
    b = F.col("pair").bitwiseAND(F.lit(2**32 - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def _scored(documents: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    links, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    links[pairs["at"]], best[pairs["at"]] = pairs["links"], pairs["best"]
    return pd.DataFrame({
        "block": documents["block"],
        "at": documents["at"],
        "n_best": [int(best[x].sum()) for x in documents["links"]],
        "count_sum": [int(links[x].sum()) for x in documents["links"]],
    })


def score(alignment: DataFrame) -> DataFrame:
    """The documents of an alignment (block, at) with ``n_best`` and ``count_sum`` over their links.

    ``n_best`` counts links whose pair is the most frequent one of its B id (ties too), ``count_sum`` adds up how often
    the pairs of all links are linked. Each block gets the counts of its own pairs, so no pair's count is sent to every
    document that holds it, and a task holds one block at a time.
    """
    counts = pair_counts(alignment)
    pairs = alignment.where("pairs is not null").select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    known = pairs.join(counts, "pair").select("of", "at", "links", "best")
    documents = alignment.where("groups is not null").select("block", "at", "links")
    both = documents.groupBy("block").cogroup(known.groupBy("of"))
    return both.applyInPandas(_scored, "block long, at long, n_best long, count_sum long")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    alignment = align(docs)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    own = alignment.where("groups is not null").select(
        "block", "at", "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("bigint").alias("n_links"), digest.alias("groups_sha256")
    )
    return own.join(score(alignment), ["block", "at"]).drop("block", "at")
