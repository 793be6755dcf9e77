"""I-Match fingerprints, language identification, packing and SentencePiece."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assayer.llm import imatch, langid, packing, pieces, subwords
from conftest import EDGE_ROWS, prose


def hashed(*values, seed=42):
    for v in values:
        raw = v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute_imatch(rows, band=imatch.BAND):
    """The query's result from (doc_id, text), without duplicates in doc_id."""
    split = lambda t: {w for w in re.split("[\x20\x09-\x0d]+", t.lower()) if w}
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    counts = {}
    for _, t in rows:
        for w in split(t):
            counts[w] = counts.get(w, 0) + 1
    n = len(rows)
    lexicon = {w for w, c in counts.items() if max(2, band[0] * n) <= c <= band[1] * n}

    def prints(t):
        ws = split(t)
        terms = sorted(signed(hashed(w)) for w in (ws & lexicon if len(ws & lexicon) >= imatch.FEW else ws))
        kept = [[x for x in terms if x & m == 0] for m in imatch.subset_masks()]
        return [hashed(*k) if k else 0 for k in kept]

    def like(a, b):
        told = [x == y for x, y in zip(a, b) if x or y]
        return sum(told) / len(told) if told else 1.0

    out = {}
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        a, b, c = prints(t), prints(e), prints(u)
        spell = lambda p: "".join(f"{x:016x}" for x in p)
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), spell(a), spell(b), like(a, b), like(a, c))
    return out


def test_imatch_of_the_given_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_imatch([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = {r[0]: tuple(r[1:]) for r in imatch.op3_imatch(spark, sf).collect()}
    assert got == want


def test_unrelated_texts_with_one_common_word_are_told_apart(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40)) + (" 2024" if i < 12 else "")) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, body string").withColumn("text", F.lit("other"))
    found = imatch.with_edits(df, text="body", band=(0.01, 0.1)).collect()
    assert len({r["fingerprint"] for r in found}) == 200
    assert all(r["near_next"] == 0 and r["fingerprint"].strip("0") for r in found)


def test_the_band_is_a_parameter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    band = (0.05, 0.6)
    got = {r[0]: tuple(r[1:]) for r in imatch.with_edits(docs, band=band).collect()}
    want = brute_imatch([tuple(r) for r in docs.collect()], band)
    assert got == want and want != brute_imatch([tuple(r) for r in docs.collect()])


def test_imatch_edges(spark, edges, none):
    rows = imatch.with_edits(edges).collect()
    assert len(rows) == len(EDGE_ROWS)
    by_text = {}
    for r, (i, t, _) in zip(sorted(rows, key=lambda r: (r["n_chars"], r["doc_id"] or 0)), sorted(EDGE_ROWS, key=lambda e: (len(e[1] or ""), e[0] or 0))):
        by_text.setdefault(t or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert {r["fingerprint"].strip("0") for r in rows if r["n_chars"] == 0} == {""}
    assert imatch.with_edits(none).count() == 0
    one = imatch.with_edits(edges.where("doc_id = 1")).first()  # its own neighbour
    assert one["near_next"] == 1.0


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return langid.train(docs)


def test_language_of_held_out_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict(docs, model).withColumn("held", langid.held_out(F.col("doc_id"))).collect()
    held = [r for r in rows if r["held"]]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert sum(r["rejected"] for r in rows) <= 0.005 * len(rows)


@pytest.mark.parametrize("unknown", ["es", "fr,es", "de,es,fr"])
def test_unknown_languages_and_gibberish_are_rejected(spark, unknown):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 100")
    foreign = F.col("lang").isin(unknown.split(","))
    found = langid.train(docs.where(~foreign))
    rows = docs.select("text", foreign.alias("foreign")).collect()
    known = [r["text"] for r in rows if not r["foreign"]]
    rng = random.Random(3)
    mixed = [a[:400] + "\n" + b[:400] for a, b in zip(known, known[50:])]
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    encoded = ["".join(rng.choice(letters) for _ in range(500)) for _ in range(50)]
    typed = [" ".join("".join(rng.choice(letters[:26]) for _ in range(rng.randrange(2, 9))) for _ in range(60)) for _ in range(50)]
    share = lambda texts: sum(found.judged(t)[1] < found.floor for t in texts) / len(texts)
    assert share([r["text"] for r in rows if r["foreign"]]) >= 0.97
    assert share(encoded) == 1 and share(typed) == 1
    assert share(known) <= 0.005 and share(mixed) <= 0.01
    plain = [("encoded", encoded[0], None), ("typed", typed[0], None), ("known", known[0], "en"), ("mixed", mixed[0], None)]
    out = langid.predict(spark.createDataFrame(plain, "doc_id string, text string, lang string"), found).collect()
    assert [r["rejected"] for r in out] == [True, True, False, False]


def test_the_sample_is_bounded_in_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "fit", lambda samples, noise, languages: seen.append((len(samples), len(noise))))
    rows = [(1, prose(1, 50), "en")] * 90 + [(1, prose(i, 50), "en") for i in range(90)]
    rows += [(i, "123 !", "de") for i in range(200)] + [(i, prose(i, 50), "de") for i in range(200, 260)]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 20)
    langid.train(spark.createDataFrame(rows[:90], "doc_id long, text string, lang string"), 20)
    assert [n for n, _ in seen] == [40, 1] and all(n <= m for m, n in seen)


def test_language_edges(spark, edges, none, model):
    out = langid.predict(edges, model).collect()
    assert len(out) == len(EDGE_ROWS)
    for r in out:
        blank = not re.search("[a-zé]", r["text"] or "")
        assert (r["lang_pred"] == "und") == blank and 0 <= r["score"] <= 1 and (not blank or r["rejected"])
    assert langid.train(none) is None
    assert {r["lang_pred"] for r in langid.predict(edges, None).collect()} == {"und"}
    assert langid.keep_known(none).count() == 0
    unlabelled = edges.withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_known(unlabelled).count() == 0


def test_cut_texts_have_the_same_subwords(monkeypatch):
    text = prose(8, 300)
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "AT_ONCE", 97)
    assert (langid.counts(text) == whole).all()


STRANGE = [
    "", "  a\x1c b c d  ", "don't WE'LL <|endoftext|>x <|endoftext|> Σας ΟΔΟΣ ﬁ é ́x 你好  \r\n\x0b\x85k",
    "a\u0000b 123 4.5 'S doń (abc) abc's... xͅΣ, İI. ǅ ß ª² Ⅷ ..'. a'.", "a▁b ▁ c\n\n d\te",
]


def test_word_cache_gives_the_tokenizer_s_ids():
    cache = packing.WordCache(packing.tokenizer_path())
    texts = STRANGE + [prose(i, 60) for i in range(3)]
    for text, ids in zip(texts, cache.encode(texts)):
        assert ids.tolist() == cache.encoder.encode(text, add_special_tokens=False).ids


def test_hilbert_curve_visits_neighbours():
    axes = np.stack(np.meshgrid(*[np.arange(4)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(axes, 2)
    assert sorted(key) == list(range(64))
    assert (np.abs(np.diff(axes[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def packed_ok(docs, rows, length):
    from assayer.llm.packing import WordCache, tokenizer_path

    cache = WordCache(tokenizer_path())
    ids = sorted(np.append(cache.encode([t or ""])[0], packing.END).astype("<u4").tobytes() for t in docs)
    used, sequences = {}, {}
    for r in rows:
        used.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(bytes(r["ids"])) == 4 * r["length"]
    for s in sequences.values():
        ends = [o + n for o, n in sorted(s)]
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= length
    full = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(n != length for n in full) <= 1 and sum(full) == sum(map(len, ids)) // 4
    return ids, rows


def test_packing_covers_each_id_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = packing.pack(docs, length=256).collect()
    ids, rows = packed_ok(texts.values(), rows, 256)
    whole = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(whole.get(r["doc_id"], b"")) // 4
        whole[r["doc_id"]] = whole.get(r["doc_id"], b"") + bytes(r["ids"])
    assert sorted(whole.values()) == ids


def test_packing_edges(spark, edges, none):
    rows = packing.pack(edges).collect()
    packed_ok([t for _, t, _ in EDGE_ROWS], rows, packing.LENGTH)
    assert packing.pack(none).count() == 0


def chunked(model, text, chunk):
    signs = pieces.spelled(text)
    count = -(-len(signs) // chunk)
    rows = []
    for k in range(count):
        at, last = max(0, k * chunk - subwords.CONTEXT), k == count - 1
        part = signs[at:] if last else signs[at : (k + 1) * chunk + subwords.WINDOW + subwords.CONTEXT]
        rows.append((part, *subwords._cuts(part, at, k, last, chunk)))
    matrices = [model.transfer(*r) for r in rows]
    states = pieces.cut_states(matrices)
    return [i for k, r in enumerate(rows) for i in model.traced(*r, states[k], states[k + 1])], matrices


def test_chunks_give_the_model_s_ids(monkeypatch):
    model, rng = pieces.Pieces(pieces.model_path()), random.Random(5)
    alphabets = [["the ", "ing", "tion", "re", "er", "th", "  ", "é", "\n", "你"], list("etaoin"), list("ab"), ["▁", " ", "x", "\t", "\n"], list("0123.,-")]
    for case in range(150):
        text = "".join(rng.choice(alphabets[case % 5]) for _ in range(rng.randrange(1, 500)))
        monkeypatch.setattr(subwords, "WINDOW", rng.choice([1, 8, 256]))
        got, matrices = chunked(model, text, rng.choice([70, 100, 333]))
        assert got == model.model.encode(text)
        if len(matrices) > 2:  # any bracketing gives the same product
            a, b, c = matrices[:3]
            assert pieces.combined(pieces.combined(a, b), c) == pieces.combined(a, pieces.combined(b, c))


def test_sentencepiece_edges(spark, edges, none):
    model = pieces.Pieces(pieces.model_path()).model
    out = subwords.decode(subwords.encode(edges, chunk=2000)).collect()
    want = sorted((i or 0, model.encode(t or ""), t or "") for i, t, _ in EDGE_ROWS)
    assert sorted((r["doc_id"] or 0, r["ids"], r["text"]) for r in out) == want
    assert subwords.encode(none).count() == 0


def test_chunks_decode_to_the_whole_text(spark, edges):
    rows = subwords.encode(edges, chunk=2000, decoded=True).collect()
    model = pieces.pieces(pieces.model_path()).model
    assert len(rows) == len(EDGE_ROWS)
    assert all(r["decoded"] == model.decode(r["ids"]) for r in rows)
    spaced = [(1, "  a  bc " * 900 + "é中😀\n" * 700), (2, " " * 5000), (3, "▁x" * 3000)]
    found = subwords.encode(spark.createDataFrame(spaced, "doc_id long, text string"), chunk=500, decoded=True).collect()
    for r in found:
        assert r["ids"] == model.encode(dict(spaced)[r["doc_id"]]) and r["decoded"] == model.decode(r["ids"])


def test_op8_is_the_library_on_the_whole_table(spark, sf):
    model = pieces.pieces(pieces.model_path()).model
    want = []
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = model.encode(d["text"] or "")
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), model.decode(ids))]
        want.append((d["doc_id"], len(ids), *digest))
    assert sorted(map(tuple, subwords.op8_sentencepiece(spark, sf).collect())) == sorted(want)
