"""SimHash near-duplicates by covering locality-sensitive hashing (operator 9)."""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer.llm.columns import packed
from assayer.llm.graph import components
from assayer.llm.tables import written

SHINGLE, RADIUS = 4, 4
SEED = 42
AT_ONCE = 1 << 15  # shingle hashes held as bits at a time
BUCKET = 4096  # fingerprints of a bucket compared in one task; larger buckets are dealt out as pairs of blocks


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles in order; a text of fewer words is one shingle, without words it has none."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: n - 1]]
    stops = ends[-n:] if n > 1 else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i : j - 1], SEED) for i, j in zip(starts, stops)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half the hashes of the word shingles; 0 for a text without words."""
    found = hashes(text, shingle)
    n = len(found)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        bits = np.unpackbits(found[at : at + AT_ONCE].astype("<u8").view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))


def hex64(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """Masks such that any two fingerprints within the radius agree on all bits of at least one.

    Each bit position gets a random vector of radius + 1 bits; mask v holds the positions whose vector is odd
    against v. The vectors of at most ``radius`` differing positions leave a non-zero v orthogonal to them all.
    """
    draw = random.Random(SEED)
    vectors = [draw.randrange(1, 2 ** (radius + 1)) for _ in range(64)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def spanning_links(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[np.uint64, np.uint64]]:
    """Links that connect whatever the links within the radius among these fingerprints connect."""
    links, rest = [], np.asarray(fps, np.int64).view(np.uint64)  # bits are counted of unsigned numbers
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            one = front.pop()
            near = np.bitwise_count(rest ^ one) <= radius
            if near.any():
                found = rest[near]
                links += [(one, x) for x in found]
                front += list(found)
                rest = rest[~near]
    return links


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        links = [x for fps in batch["fps"] for x in spanning_links(fps)]
        yield pd.DataFrame(np.array(links, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) within the radius that connect the distinct fingerprints ``fp``.

    A table per covering mask; fingerprints that agree under it meet in a bucket. Inside a bucket a search from
    fingerprint to fingerprint yields a spanning forest, so its links grow with its members and not with its pairs.
    Buckets over ``bucket`` members are cut into blocks by hash, and every pair of blocks meets in a task of its own.
    Spark sizes the exploded table by its rows before the explode and would broadcast it: the join is told to sort.
    """
    signed = [m - 2**64 if m >= 2**63 else m for m in covering_masks(radius)]
    cells = F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(signed)])
    keyed = distinct.select("fp", F.inline(cells))
    shared = keyed.groupBy("v", "key").count().where("count > 1")
    blocks = F.ceil(F.col("count") / bucket).cast("int")
    met = keyed.hint("merge").join(shared, ["v", "key"]).withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("blocks"), F.lit(1)) - 1),
        lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y")),
    )
    dealt = met.select("v", "key", "fp", F.inline(pairs))
    together = dealt.groupBy("v", "key", "x", "y").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return together.select("fps").mapInPandas(_linked, "a long, b long").distinct()


NO_ID = -(2**63)  # stands for a null doc_id where rows are matched


def _prints(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, mark, fp) per document, written; the mark tells texts of one doc_id apart."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), _fingerprints(F.col(text)).alias("fp"))
    return written(own, "prints")


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-prints")
    found = components(links(distinct, radius))
    labelled = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    )
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    # Copies pack so well that a file of few bytes can hold any number of rows: never broadcast by its size.
    return prints.hint("merge").join(labelled.join(least, "label").select("fp", "label", "component_id"), "fp")


def near_groups(docs: DataFrame, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) per document; the component is the smallest doc_id that links can reach.

    A null text has no words: fingerprint 0, linked like any other. A null doc_id is never the smallest unless the
    component has no other. Repeated rows share their fingerprint. Other columns are ignored.
    """
    return _grouped(_prints(docs, text, doc_id), radius).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group, with the input's own columns: the smallest doc_id's, nulls last.

    Ties go by text hash, and rows with equal id and text by their other columns as JSON.
    """
    own = lambda c: F.coalesce(c.cast("bigint"), F.lit(NO_ID))
    groups = _grouped(_prints(docs, "text", "doc_id"), radius)
    lead = groups.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("lead"))
    chosen = lead.select(own(F.col("lead.doc_id")).alias("d"), F.col("lead.mark").alias("m"))
    others = F.to_json(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]))
    rows = packed(docs, d=own(docs["doc_id"]), m=F.xxhash64(docs["text"]), others=others)
    kept = rows.join(chosen, ["d", "m"], "left_semi").groupBy("d", "m").agg(F.min_by("row", "others").alias("row"))
    return kept.select("row.*")


def op9_covering_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
