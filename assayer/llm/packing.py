"""Packing documents into sequences along a space-filling curve (operator 7)."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from assayer.llm.parts import PartCache
from assayer.llm.tables import written

LENGTH, END = 4096, 2
HASHED = 1024  # entries of a document's hashed vector
AXES, BITS = 4, 8  # of the projected vector
TOKENIZER = "word_bpe_49k.json"
LEVELS = (14, 28)  # bits by which blocks of the curve are gathered for running sums

DONE = "doc_id long, row_id long, ids binary, n_tokens long, curve long, tie long"


@lru_cache(2)
def _encoder(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCache(PartCache):
    """Token ids of texts, put together from the ids of their space-separated words.

    For a tokenizer that lower-cases, drops white space and splits off runs of letters and of punctuation, so that no
    piece crosses a space and a word's ids do not depend on its neighbours. A new word of letters with punctuation
    behind goes to the tokenizer's model in these two parts; every other word goes through the whole tokenizer.
    """

    TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str):
        self.encoder = _encoder(path)
        self.model = self.encoder.model
        self.letters = _byte_letters()
        super().__init__()

    def _reset(self) -> None:
        super()._reset()
        self.parts: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return text.replace("\n", " ").replace("\t", " ").split(" ")

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            spelled = "".join([self.letters[b] for b in part.encode()])
            found = self.parts[part] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return found

    def ids_of(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        whole: list[int] = []
        for word in words:
            low = word.replace("Σ", "σ").lower()
            stem = low.rstrip(self.TAIL)
            if (stem.isalpha() or not stem) and (low.isascii() or is_normalized("NFC", word)):
                out.append((self._part(stem) if stem else b"") + (self._part(low[len(stem) :]) if len(stem) < len(low) else b""))
            else:
                whole.append(len(out))
                out.append(b"")
        found = self.encoder.encode_batch_fast([words[i] for i in whole], add_special_tokens=False)
        for i, e in zip(whole, found):
            out[i] = array("I", e.ids).tobytes()
        return out

@lru_cache(1)
def _cache(path: str) -> WordCache:
    return WordCache(path)  # one per Python worker, which serves many tasks


def hilbert(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of whole coordinates (rows) in [0, 2**bits), by Skilling's transform."""
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@lru_cache(1)
def _projection() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(11)
    return draw.integers(0, HASHED, 1 << 17), draw.normal(0, 1, (HASHED, AXES))


def projected(ids: np.ndarray) -> np.ndarray:
    """A document's hashed token counts (square roots, unit length) on a few random axes."""
    slots, axes = _projection()
    n = np.sqrt(np.bincount(slots[ids % len(slots)], minlength=HASHED))
    return (n / max(np.sqrt((n * n).sum()), 1e-9)) @ axes


def coordinates(points: np.ndarray) -> np.ndarray:
    """Projected values in (-4, 4) as whole numbers; rarer ones go to the ends."""
    return np.clip((points + 4) * (2**BITS / 8), 0, 2**BITS - 1).astype(np.int64)


def _tokenized(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _cache(path)
        for batch in batches:
            ids = [np.append(x, np.uint32(END)) for x in cache.encode([t or "" for t in batch["text"]])]
            points = np.array([projected(x) for x in ids]).reshape(-1, AXES)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "row_id": batch["row_id"],
                "ids": [x.astype("<u4").tobytes() for x in ids],
                "n_tokens": [len(x) for x in ids],
                "curve": hilbert(coordinates(points)),
                "tie": batch["tie"],
            })

    return run


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token ids (unsigned 32-bit, little-endian) with the end id, and the place on the curve, written."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.monotonically_increasing_id().alias("row_id"),
        F.xxhash64("doc_id", "text").alias("tie"),
        "text",
    )
    return written(rows.mapInPandas(_tokenized(path or tokenizer_path()), DONE), "tokens")


def _before(totals: DataFrame) -> DataFrame:
    """(block, before): the sum of ``n`` over all lower blocks; no ordered window holds over 2**14 rows."""
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = [totals.withColumn("k", F.col("block"))]
    sums += [totals.groupBy(F.shiftright("block", b).alias("k")).agg(F.sum("n").alias("n")) for b in LEVELS]
    # The last level has at most 2**12 rows: a place on the curve has AXES * BITS bits, a block 8 more.
    before = sums[-1].select("k", earlier(Window.orderBy("k")).alias("before"))
    for level, bits in zip(sums[-2::-1], (LEVELS[1] - LEVELS[0], LEVELS[0])):
        own = level.withColumn("up", F.shiftright("k", bits))
        own = own.withColumn("inside", earlier(Window.partitionBy("up").orderBy("k")))
        higher = before.select(F.col("k").alias("up"), F.col("before").alias("higher"))
        before = own.join(higher, "up").select("k", (F.col("higher") + F.col("inside")).alias("before"))
    return before.withColumnRenamed("k", "block")


def starts(tokens: DataFrame) -> DataFrame:
    """(row_id, first): tokens before each document along the curve.

    Documents of one place go by a hash of id and text, so that a crowded place still spreads over blocks. Running
    sums are taken within blocks of the curve; blocks meet through one row each.
    """
    thin = tokens.select("row_id", "n_tokens", "curve", "tie")
    share = F.shiftright(F.col("tie"), 56) + 128  # 0..255
    blocked = thin.withColumn("block", F.col("curve") * 256 + share)
    totals = blocked.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    before = _before(totals)
    own = Window.partitionBy("block").orderBy("tie", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.withColumn("c", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
        .join(before, "block")
        .select("row_id", (F.col("before") + F.col("c")).alias("first"))
    )


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    Documents follow each other along the curve and are cut where a sequence is full, so only the last sequence is
    short. A null text is empty and yields the end id alone; repeated rows are packed each. Other columns are ignored.
    """
    tokens = tokenized(docs, path)
    placed = tokens.select("row_id", "doc_id", "ids", "n_tokens").join(starts(tokens), "row_id")
    first, end = F.col("first"), F.col("first") + F.col("n_tokens")
    sequences = F.sequence(F.floor(first / length), F.floor((end - 1) / length))
    cut = placed.select("doc_id", "ids", "n_tokens", "first", F.explode(sequences).alias("sequence_id"))
    lower = F.greatest(F.col("first"), F.col("sequence_id") * length)
    upper = F.least(F.col("first") + F.col("n_tokens"), (F.col("sequence_id") + 1) * length)
    return cut.select(
        "doc_id",
        (lower - F.col("first")).alias("start"),
        (upper - lower).alias("length"),
        F.col("n_tokens").alias("doc_tokens"),
        "sequence_id",
        (lower - F.col("sequence_id") * length).alias("offset"),
        F.substring("ids", ((lower - F.col("first")) * 4 + 1).cast("int"), ((upper - lower) * 4).cast("int")).alias("ids"),
    )


def op7_curve_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
