"""Alignment of tokenizers, byte-pair encoding and vector codes."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from assayer.llm import alignment, bpe, codes, packing
from conftest import EDGE_ROWS

SIGNS = [
    "a", "b", "aa", "the", "ing", "é", "é", "Σ", "ς", "İ", "ß", "ﬁ", "中", "文", "‍", "😀", "'s", "'LL", "1", "23", "٣", " ", "  ", "\n",
    "\t", " ", " ", "\x00", "\x1c", "\x85", "!", "--", "<|endoftext|>", "<|startoftext|>", "<|ENDoftext|>", "</w>", "Ġ", "￿", "�",
    "ÿ", "ǅ", "̈", "가", "x" * 70, "ab" * 40, "0" * 20, "zzzq", "▁", "<s>", "</s>", "<unk>", "<0x41>", "­",
]


def odd_texts(n: int) -> list[str]:
    rng = random.Random(5)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    return texts + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCé \n") for _ in range(rng.randint(0, 90))) for _ in range(n)]


# Byte-pair encoding


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.tokenizer_path())


@pytest.fixture(scope="module")
def words():
    return bpe.Words(packing.tokenizer_path())


def test_ids_are_the_librarys(library, words):
    texts = [*odd_texts(3000), "", "x" * 30_000, "".join(random.Random(1).choice("abcdefgh") for _ in range(30_000)), "word " * 20_000]
    for at in range(0, len(texts), 500):
        ids, ends = words.encode(pa.array(texts[at : at + 500], pa.string()))
        for text, a, b in zip(texts[at : at + 500], ends, ends[1:]):
            want = library.encode(text, add_special_tokens=False).ids
            assert ids[a:b].tolist() == want, repr(text)
            assert words.decode(ids[a:b]) == library.decode(want, skip_special_tokens=False)


def merged(letters: list[str], merges: dict[tuple[str, str], int]) -> list[str]:
    """Merging by rank, the leftmost of equal ones first."""
    while True:
        ranked = [(merges[p], i) for i, p in enumerate(zip(letters, letters[1:])) if p in merges]
        if not ranked:
            return letters
        i = min(ranked)[1]
        letters = [*letters[:i], letters[i] + letters[i + 1], *letters[i + 2 :]]


@pytest.mark.parametrize("suffix", ["", "</w>"])
def test_any_merges_give_what_merging_gives(suffix):
    rng = random.Random(7)
    for _ in range(40):
        base = ["a", "b", "c"]
        tokens = base + [x + suffix for x in base if suffix]
        merges: list[tuple[str, str]] = []
        while len(merges) < 12:
            a, b = rng.choice(tokens), rng.choice(tokens)
            if (suffix and a.endswith(suffix)) or a + b in tokens:
                continue
            merges.append((a, b))
            tokens.append(a + b)
        model = bpe.WordModel({t: i for i, t in enumerate(tokens)}, merges, suffix)
        rank = {m: r for r, m in enumerate(merges)}
        given = ["".join(rng.choice(base) for _ in range(rng.choice([1, 2, 5, 9, 30, 90]))) for _ in range(40)]
        for word, ids in zip(given, model.encode([w.encode() for w in given])):
            letters = [*word[:-1], word[-1] + suffix]
            assert [tokens[i] for i in np.frombuffer(ids, np.uint32)] == merged(letters, rank), (word, merges)


def test_pair_tests_start_anew_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "PAIRS", 64)
    monkeypatch.setattr(bpe.PairTests, "_places", _few_places)
    tests = bpe.PairTests(lambda a, b: (a * 7 + b) % 3 == 0, 100)
    rng = np.random.default_rng(1)
    for n in (5, 20, 20, 40, 200, 10):
        a, b = rng.integers(0, 100, n), rng.integers(0, 100, n)
        assert tests(a, b).tolist() == [(x * 7 + y) % 3 == 0 for x, y in zip(a.tolist(), b.tolist())]


def _few_places(self, keys):
    at = keys % bpe.PAIRS
    while len(away := np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))):
        at[away] = (at[away] + 1) % bpe.PAIRS
    return at


def test_op12_is_the_library_on_the_whole_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = []
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text)]
        want.append((d["doc_id"], len(ids), *digest))
    assert sorted(map(tuple, bpe.op12_bpe(spark, sf).collect())) == sorted(want)


def test_bpe_edges(edges, none, library):
    rows = bpe.decode(bpe.encode(edges, decoded=True)).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in EDGE_ROWS]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r["doc_id"], r["ids"]) for r in rows], key=key) == sorted(want, key=key)
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in rows)
    assert bpe.encode(none, decoded=True).count() == 0
    assert bpe.decode(bpe.encode(none)).count() == 0


# Alignment


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(alignment.path("byte_bpe_50k.json"), alignment.path("piece_bpe_32k.model"))


def brute_groups(aligner, text):
    """[(ids of A, ids of B)] by comparing all ends of tokens of the whole text."""
    if not text:
        return []
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    wanted = (" " + text).encode()
    if b"".join(aligner.bytes_a[i] for i in a) != wanted or b"".join(aligner.bytes_b[i] for i in b) != wanted:
        return []
    ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for table, ids in ((aligner.bytes_a, a), (aligner.bytes_b, b))]
    out, i, j = [], 0, 0
    places = [{e: k + 1 for k, e in enumerate(x)} for x in ends]
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = places[0][end], places[1][end]
        out.append((a[i:x], b[j:y]))
        i, j = x, y
    return out


def spelled(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def test_groups_are_those_of_all_ends(aligner):
    texts = [None, *odd_texts(1500), "ab " * 20_000, "x" * 40_000]
    for at in range(0, len(texts), 400):
        some = texts[at : at + 400]
        found = aligner.align(pa.array(some, pa.string()))
        assert found.groups == [spelled(brute_groups(aligner, t)) for t in some]


def test_halving_finds_every_common_end():
    rng = np.random.default_rng(3)
    for density in (0.02, 0.3, 0.9):
        ends_a, ends_b, starts_a, starts_b, at = [], [], [0], [0], 0
        for size in [1, 2, 3, 50, 4000, 1]:
            for ends in (ends_a, ends_b):
                inner = np.flatnonzero(rng.random(size - 1) < density) + 1
                ends += [at + x for x in [*inner.tolist(), size]]
            at += size
            starts_a.append(len(ends_a))
            starts_b.append(len(ends_b))
        a, b = alignment.common_ends(*(np.array(x) for x in (ends_a, ends_b, starts_a, starts_b)))
        assert [ends_a[i] for i in a] == [ends_b[i] for i in b] == sorted(set(ends_a) & set(ends_b))


def brute_alignment(aligner, rows):
    groups = [(i, brute_groups(aligner, t)) for i, t in rows]
    links = [[(a[-1], b[-1]) for a, b in g] for _, g in groups]
    counts = collections.Counter(x for l in links for x in l)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for (i, g), l in zip(groups, links):
        n_a, n_b = (sum(len(x[k]) for x in g) for k in (0, 1))
        best = sum(counts[x] == most[x[1]] for x in l)
        digest = hashlib.sha256(spelled(g).encode()).hexdigest() if g else ""
        out.append((i, n_a, n_b, len(g), len(l), best, sum(counts[x] for x in l), digest))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_op11_on_the_whole_table(spark, sf, aligner):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(3)
    got = alignment.op11_alignment(spark, sf).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute_alignment(aligner, [tuple(r) for r in docs.collect()])


def test_alignment_edges(spark, edges, none, aligner):
    found = alignment.align(edges.repartition(3))
    counted = alignment.score(found).join(found.where("groups is not null"), ["block", "at"]).collect()
    want = {(w[0], *w[1:3], *w[5:7]) for w in brute_alignment(aligner, [r[:2] for r in EDGE_ROWS])}
    assert len(counted) == len(EDGE_ROWS)
    assert {(r["doc_id"], r["n_a"], r["n_b"], r["n_best"], r["count_sum"]) for r in counted} == want
    arrays = {(r["doc_id"], spelled([(g["a"], g["b"]) for g in r["groups"]])) for r in alignment.group_arrays(found).collect()}
    assert arrays == {(i, spelled(brute_groups(aligner, t))) for i, t, _ in EDGE_ROWS}
    assert alignment.score(alignment.align(none)).count() == 0


# Vector codes


def brute_codes(vectors, parts, entries, rounds, scale):
    """[(code, error)] and codebooks by full searches over Python's whole numbers."""
    whole = [[int(np.floor(np.float64(x) * scale)) for x in v] for v in vectors]
    d = len(whole[0]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    gap = lambda x, c: sum((i - j) ** 2 for i, j in zip(x, c))
    near = lambda x, book: min(range(len(book)), key=lambda e: (gap(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            members = collections.defaultdict(list)
            for v in cut:
                members[near(v[p], books[p])].append(v[p])
            for e, m in members.items():
                books[p][e] = [sum(x) // len(m) for x in zip(*m)]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    return [(c, sum(gap(v[p], books[p][c[p]]) for p in range(parts))) for c, v in zip(found, cut)], books


@pytest.mark.parametrize("entries,rounds", [(16, 6), (3, 0), (5, 9), (1, 2)])
def test_codes_are_those_of_full_searches(spark, entries, rounds):
    rng = np.random.default_rng(entries)
    centres = rng.normal(0, 2, (9, 8))
    vectors = np.round(centres[rng.integers(0, 9, 300)] + rng.normal(0, 0.3, (300, 8)), 1).tolist()  # with ties
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(5)
    rows, books = codes.compress(df, 4, entries, rounds, 10)
    want, want_books = brute_codes(vectors, 4, entries, rounds, 10)
    got = {r["vec_id"]: (r["code"], r["error"]) for r in rows.collect()}
    assert [got[i] for i in range(300)] == want
    assert books.tolist() == want_books


def test_bounds_spare_scans_and_stay_exact():
    rng = np.random.default_rng(2)
    v = (rng.integers(0, 6, (4000, 2, 1)) * 5000 + rng.integers(-300, 300, (4000, 2, 4))).astype(np.int64)
    history = v[:6].swapaxes(0, 1)[None]
    bounds, scanned = codes.start(v, history[0]), []
    for t in range(6):
        sums, counts = np.zeros(history.shape[1:], np.int64), np.zeros(history.shape[1:3], np.int64)
        for p in range(2):
            np.add.at(sums[p], bounds.near[:, p], v[:, p])
            np.add.at(counts[p], bounds.near[:, p], 1)
        history = np.concatenate([history, codes.moved_book(history[-1], sums, counts)[None]])
        bounds, n = codes.advance(v, bounds, history)
        scanned.append(n)
        full = codes.start(v, history[-1])
        assert (bounds.near == full.near).all()
        drift = np.sqrt(((np.diff(history, axis=0).astype(float)) ** 2).sum(-1)).sum(0)
        assert (codes.displacements(history)[0] <= drift * (1 + 1e-9)).all()
        for p in range(2):
            exact = np.sqrt(codes.squared(v[:, p], history[-1][p]).min(axis=1))
            assert (bounds.up[:, p] + codes.displacements(history)[bounds.up_at[:, p], p, bounds.near[:, p]] >= exact).all()
    assert scanned[-1] < 0.2 * v.shape[0] * v.shape[1]


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 2.0], "x", 1),
        (5, [1.0, 2.0], "x", 1),  # a repeated row
        (5, [0.5, -2.0], None, 2),  # a tie
        (1, None, "x", 3),
        (2, [1.0, None], "x", 4),
        (3, [nan, 1.0], "x", 5),
        (4, [1.0, -inf], "x", 6),
        (None, [3.0, 3.0], None, 7),
        (6, [1.0, 2.0, 3.0, 4.0], "y", 8),  # another length
        (7, [], "y", 9),
        (8, [1e30, 0.0], "y", 10),  # beyond exact numbers
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, code int").withColumnRenamed("code", "near")
    found, books = codes.compress(df, 2, 16, 3, 4)
    got = sorted((r["near"], r["code"], r["error"]) for r in found.collect())
    want, _ = brute_codes([[0.5, -2.0], [1.0, 2.0], [1.0, 2.0], [3.0, 3.0]], 2, 16, 3, 4)
    assert got == [(1, *want[1]), (1, *want[2]), (2, *want[0]), (7, *want[3]), (8, None, None), (9, None, None), (10, None, None)]
    assert books.shape == (2, 4, 1)
    empty, books = codes.compress(df.where("false"))
    assert empty.count() == 0 and books.shape[1] == 0
