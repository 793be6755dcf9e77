"""Language identification by averaged hashed subword embeddings and a linear softmax (operator 10)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from assayer.llm.columns import packed, unpacked

BUCKETS = 1 << 15
ORDERS = (2, 3, 4)  # lengths of the subwords in code points
WIDTH = 16  # of an embedding
PER_LANGUAGE = 500  # training rows of a language; the sample is the bound on what reaches the driver
EPOCHS, RATE = 6, 0.5
SMOOTHING = 0.5  # added to the count of each bucket
SHUFFLED = 5  # every so many training texts are also counted with their letters shuffled
# Calibration: this share of the known texts on one side, of the negatives on the other. The floor is put nearer to the
# negatives, since texts of known languages also hold foreign passages.
TAIL, PART = 0.005, 0.25
AT_ONCE = 1 << 20  # code points hashed at a time
UNKNOWN = "und"
PRIMES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points with everything but letters as 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return np.where(_letter_table()[points], points, np.uint32(0))


def subwords(points: np.ndarray, starts: int) -> np.ndarray:
    """Buckets of the subwords that begin at the first ``starts`` places; windows without a letter are left out."""
    out = []
    for n in ORDERS:
        size = min(len(points) - n + 1, starts)
        if size <= 0:
            continue
        mixed = np.zeros(size, np.uint32)
        seen = np.zeros(size, bool)
        for k in range(n):
            part = points[k : k + size]
            mixed = (mixed ^ (part * np.uint32(PRIMES[k]))) * np.uint32(0x01000193) + np.uint32(n)
            seen |= part > 0
        mixed ^= mixed >> np.uint32(15)
        out.append((mixed & np.uint32(BUCKETS - 1))[seen])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def hashed(text: str) -> Iterator[np.ndarray]:
    """The buckets of all subwords of the whole text, a bounded number at a time; word ends count as characters."""
    zero = np.zeros(1, np.uint32)
    points = np.concatenate([zero, code_points(text), zero])
    for at in range(0, len(points), AT_ONCE):
        yield subwords(points[at : at + AT_ONCE + max(ORDERS) - 1], AT_ONCE)


def shuffled(text: str) -> str:
    """The text with its letters in random places, the same for the same text; all else stays in place."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).copy()
    at = np.flatnonzero(_letter_table()[points])
    points[at] = points[np.random.default_rng(zlib.crc32(points.tobytes())).permutation(at)]
    return points.tobytes().decode("utf-32-le")


def counts(text: str) -> np.ndarray:
    """How often each bucket occurs in the whole text."""
    return sum((np.bincount(x, minlength=BUCKETS) for x in hashed(text)), np.zeros(BUCKETS, np.int64))


@dataclass(frozen=True)
class Model:
    """Scores per bucket and language (embeddings times weights), bias and temperature; familiarity per bucket and its floor.

    Probabilities say which of the known languages a text is in, not whether it is in any. That is told by its
    familiarity: the mean over its subwords of the log frequency, against an even spread, in the language that has the
    subword most. Each subword is judged by its own best language, so texts that mix known languages stay familiar.
    """

    languages: tuple[str, ...]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    familiarity: np.ndarray
    floor: float

    def judged(self, text: str) -> tuple[np.ndarray, float] | None:
        """Probabilities of the languages and familiarity; None for a text without letters."""
        total, familiar, n = np.zeros(len(self.languages)), 0.0, 0
        for found in hashed(text):
            total += self.scores[found].sum(axis=0, dtype=np.float64)
            familiar += self.familiarity[found].sum(dtype=np.float64)
            n += len(found)
        if not n:
            return None
        z = (total / n + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum(), familiar / n


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


Counted = tuple[np.ndarray, np.ndarray]  # buckets that occur, and how often


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], noise: list[Counted], languages: tuple[str, ...], seed: int = 7) -> Model:
    """Stochastic gradient descent over (buckets, counts, label); every fifth sample calibrates instead.

    ``noise`` are counts of texts in no language.
    """
    draw = np.random.default_rng(seed)
    table = draw.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights = draw.normal(0, 1 / WIDTH, (WIDTH, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    held = samples[::5] if len(samples) >= 50 else samples
    train = [s for i, s in enumerate(samples) if i % 5] if len(samples) >= 50 else samples
    steps, step = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in draw.permutation(len(train)):
            buckets, n, label = train[i]
            share = (n / n.sum()).astype(np.float32)
            mean = share @ table[buckets]
            error = _softmax(mean @ weights + bias)
            error[label] -= 1
            rate = np.float32(RATE * (1 - step / steps))
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * error * np.float32(0.1)
            table[buckets] -= rate * len(buckets) ** 0.5 * np.outer(share, back)
            step += 1
    scores = table @ weights
    logits = np.array([(n / n.sum()) @ scores[b] + bias for b, n, _ in held])
    labels = np.array([label for *_, label in held])
    at = np.arange(len(labels))
    loss = {t: -np.log(_softmax(logits / t)[at, labels] + 1e-12).mean() for t in np.geomspace(0.05, 5, 40)}
    temperature = float(min(loss, key=loss.get))
    return Model(languages, scores, bias, temperature, *_familiarity(samples, noise, len(languages)))


def _familiarity(samples: list[tuple[np.ndarray, np.ndarray, int]], noise: list[Counted], n: int) -> tuple[np.ndarray, float]:
    """Familiarity of each bucket, and the floor below which a text is in no known language.

    Known texts are scored without their own counts. Negatives are the noise, and each text scored without all texts
    of its language, as if that language were unknown.
    """
    total = np.zeros((n, BUCKETS))
    for buckets, times, label in samples:
        total[label, buckets] += times
    sums = total.sum(axis=1)

    def mean(buckets: np.ndarray, times: np.ndarray, less: int | None = None, without: int | None = None) -> float:
        own, every = total[:, buckets], sums.copy()
        if less is not None:
            own[less] -= times
            every[less] -= times.sum()
        share = (own + SMOOTHING) / (every + SMOOTHING * BUCKETS)[:, None]
        if without is not None:
            share = np.delete(share, without, axis=0)
        return float(times @ np.log(share.max(axis=0) * BUCKETS) / times.sum())

    known = np.array([mean(b, t, less=label) for b, t, label in samples])
    others = [mean(b, t) for b, t in noise]
    if n > 1:
        others += [mean(b, t, without=label) for b, t, label in samples]
    share = (total + SMOOTHING) / (sums + SMOOTHING * BUCKETS)[:, None]
    return np.log(share.max(axis=0) * BUCKETS).astype(np.float32), _floor(known, np.array(others))


def _floor(known: np.ndarray, others: np.ndarray) -> float:
    """Between the tails of the known and of the other texts; if these overlap, where most are told apart."""
    if not len(others):
        return float(known.min())
    low, high = np.quantile(known, TAIL), np.quantile(others, 1 - TAIL)
    if high < low:
        return float(high + PART * (low - high))
    known, others = np.sort(known), np.sort(others)
    at = np.concatenate([known, others])
    right = 1 - np.searchsorted(known, at) / len(known) + np.searchsorted(others, at) / len(others)
    return float(at[right.argmax()])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def held_out(doc_id: Column) -> Column:
    """Every fourth document by crc32 of its id; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for lang, text in zip(batch["lang"], batch["text"]):
            n = counts(text)
            found = np.flatnonzero(n)
            if len(found):
                rows.append((lang, found.astype("<u4").tobytes(), n[found].astype("<u4").tobytes()))
                if zlib.crc32(text.encode("utf-8", "replace")) % SHUFFLED == 0:
                    n = counts(shuffled(text))
                    found = np.flatnonzero(n)
                    rows.append((None, found.astype("<u4").tobytes(), n[found].astype("<u4").tobytes()))
        yield pd.DataFrame(rows, columns=["lang", "buckets", "counts"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on at most ``per_language`` labelled, not held-out texts of each language, chosen by a hash of id and text.

    Whole texts are counted in tasks; what reaches the driver is a row of at most ``BUCKETS`` counts each, and another
    for the few that are also shuffled. None if no row with a letter is labelled. Repeated rows count once, and an id
    with many texts once for each. Keys alone are ranked, and of a language only those whose hash falls into a share
    that holds about twice the sample, so that no task ranks more however large the language is. The chosen keys are
    few and bounded, so they are broadcast.
    """
    labelled = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
    usable = docs.where(labelled & has_letter(F.col("text"))).select("doc_id", "lang", "text", F.xxhash64("text").alias("mark"))
    key = ["doc_id", "lang", "mark"]
    ids = usable.select(*key).distinct().withColumn("h", F.pmod(F.xxhash64(*key), F.lit(1 << 30)))
    near = ids.join(ids.groupBy("lang").agg(F.count("*").alias("rows")), "lang").where(
        F.col("h").cast("double") * F.col("rows") < float(1 << 30) * 2 * per_language
    )
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "mark")
    chosen = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select(*key)
    found = usable.join(F.broadcast(chosen), key, "left_semi")
    sample = found.groupBy(*key).agg(F.first("text").alias("text"))
    rows = sample.select("lang", "text").mapInPandas(_features, "lang string, buckets binary, counts binary").collect()
    if not rows:
        return None
    numbers = lambda b: np.frombuffer(b, "<u4")
    rows = [(r["lang"], bytes(r["buckets"]), bytes(r["counts"])) for r in rows]
    noise = [(numbers(b), numbers(n)) for lang, b, n in rows if lang is None]
    rows = sorted((b, n, lang) for lang, b, n in rows if lang is not None)
    languages = tuple(sorted({lang for *_, lang in rows}))
    samples = [(numbers(b), numbers(n), languages.index(lang)) for b, n, lang in rows]
    order = np.random.default_rng(3).permutation(len(samples))
    return fit([samples[i] for i in order], noise, languages)


_ANSWER = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("familiar", T.BooleanType())])


def _predictor(model: Model | None):
    @F.pandas_udf(_ANSWER)
    def answer(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                found = model.judged(text) if model is not None and text else None
                if found is None:
                    rows.append((UNKNOWN, 0.0, False))
                else:
                    p, familiar = found
                    rows.append((model.languages[p.argmax()], round(float(p.max()), 6), familiar >= model.floor))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "familiar"])

    return answer


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The input with ``lang_pred``, ``score`` (calibrated probability) and ``rejected``.

    Only the text is read, whole. Null, empty and letterless texts are ``und`` with score 0 and rejected, as is
    every text if there is no model. Rejected are also texts less familiar than the model's floor: those in an unknown
    language or in none. Input columns that bear an output's name are replaced.
    """
    named = packed(docs, t=docs[f"`{text}`"]).withColumn("a", _predictor(model)(F.when(has_letter(F.col("t")), F.col("t"))))
    out = named.select("row", "a.lang_pred", "a.score", (~F.col("a.familiar")).alias("rejected"))
    return unpacked(out, "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """Documents whose language is accepted, with the input's own columns."""
    model = train(docs)
    named = packed(docs, t=docs["text"]).withColumn("a", _predictor(model)(F.when(has_letter(F.col("t")), F.col("t"))))
    return named.where("a.familiar").select("row.*")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
