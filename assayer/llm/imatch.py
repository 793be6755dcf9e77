"""Document fingerprints by I-Match with randomised lexicons (operator 3)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.llm.columns import let, words
from assayer.llm.tables import written

# A term is kept if it occurs in 0.2 % to 10 % of the documents. The lower share bounds the lexicon whatever the
# number of documents: at most (distinct terms of a mean document) / 0.002 terms can reach it.
BAND = (0.002, 0.1)
LARGEST_LEXICON = 2_000_000
# Three random lexicon subsets for each share of 1/4, 1/16, 1/64 and 1/256 of the terms.
SUBSET_BITS = (2, 4, 6, 8)
PER_SHARE = 3
FEW = 8  # a text with fewer terms in the band is told by all its terms: a number or a name does not make two texts alike
NO_ID = -(2**63)
ROWS_A_BLOCK = 200_000


def subset_masks() -> list[int]:
    """A term is in a subset if the mask's bits of its hash are all zero; the masks share no bit. The first has all terms."""
    masks, at = [0], 0
    for bits in SUBSET_BITS:
        for _ in range(PER_SHARE):
            mask = ((1 << bits) - 1) << at
            masks.append(mask - 2**64 if mask >= 2**63 else mask)
            at += bits
    return masks


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased words."""
    return F.array_distinct(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text", band: Sequence[float] = BAND) -> np.ndarray:
    """Hashes of the terms within the band, counted over all documents; a term in one document alone is never kept.

    Its size is bounded by the band's lower share and checked; it does not grow with the number of documents.
    """
    n = docs.count()
    counts = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").count()
    low, high = max(2, band[0] * n), band[1] * n
    kept = counts.where(F.col("count").between(low, high)).select("term")
    found = [r[0] for r in kept.limit(LARGEST_LEXICON + 1).collect()]
    if len(found) > LARGEST_LEXICON:
        raise ValueError(f"over {LARGEST_LEXICON} terms in the band {band}; raise its lower share")
    return np.sort(np.array(found, np.int64))


class Lexicon:
    """A literal hash table: all terms ordered by bucket, and where each bucket begins."""

    def __init__(self, found: np.ndarray):
        self.size = 1 << max(0, int(len(found) - 1).bit_length()) if len(found) else 1
        bucket = found & (self.size - 1)
        ordered = found[np.argsort(bucket, kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=self.size))])
        self.terms, self.ends = _longs(ordered), _longs(ends).cast("array<int>")

    def holds(self, term: Column) -> Column:
        at = term.bitwiseAND(F.lit(self.size - 1)).cast("int")
        first = F.get(self.ends, at)
        return F.array_contains(F.slice(self.terms, first + 1, F.get(self.ends, at + 1) - first), term)


def _longs(values: np.ndarray) -> Column:
    """An array literal of any length as one string, which the optimizer folds."""
    if not len(values):
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>")


def fingerprint(text: Column, known: Lexicon) -> Column:
    """One hash per lexicon subset of the text's sorted distinct terms in it; 0 where it has none.

    A text with fewer than ``FEW`` terms in the band uses all its terms instead. Without words all hashes are 0.
    """
    masks = subset_masks()
    hashed = lambda ts, m: let(F.filter(ts, lambda t: t.bitwiseAND(F.lit(m)) == 0), lambda s: F.when(F.size(s) > 0, F.xxhash64(s)).otherwise(F.lit(0)))
    prints = lambda ts: F.array(*[hashed(ts, m) for m in masks])

    def banded(ts: Column) -> Column:
        return let(F.filter(ts, known.holds), lambda kept: F.when(F.size(kept) >= FEW, kept).otherwise(ts))

    return let(F.sort_array(let(terms(text), banded)), prints)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets in which either text has a term; 1 if neither has any."""
    used = F.zip_with(a, b, lambda x, y: F.when((x != 0) | (y != 0), (x == y).cast("int")))
    told = F.filter(used, lambda x: x.isNotNull())
    return F.when(F.size(told) == 0, F.lit(1.0)).otherwise(
        F.size(F.filter(told, lambda x: x == 1)).cast("double") / F.size(told)
    )


def spelled(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _order() -> list[Column]:
    return [F.col("d").desc(), F.col("m")]


def neighbours(docs: DataFrame) -> DataFrame:
    """(d, m, pd, pm, half): for each distinct document the one before it in descending doc_id, and half its length.

    The first document comes after the last. Only ids, text hashes and lengths move: they are range-sorted, numbered
    by partition, and each partition's ends are joined through one row each.
    """
    spark = docs.sparkSession
    thin = docs.groupBy("d", "m").agg(F.first("half").alias("half"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // ROWS_A_BLOCK)
    ranged = written(thin.repartitionByRange(parts, *_order()).withColumn("block", F.spark_partition_id()), "ordered")
    key = F.struct("d", "m", "half")
    last = ranged.groupBy("block").agg(F.max_by(key, F.struct(-F.col("d").cast("decimal(20,0)"), F.col("m"))).alias("last"))
    across = Window.orderBy("block")  # one row per block
    ends = last.select(
        "block",
        F.coalesce(F.lag("last").over(across), F.last("last").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"),
    )
    inside = Window.partitionBy("block").orderBy(*_order())
    own = ranged.withColumn("p", F.lag(key).over(inside)).join(ends, "block")
    before = F.coalesce("p", "before")
    return own.select("d", "m", before["d"].alias("pd"), before["m"].alias("pm"), before["half"].alias("half"))


def with_edits(docs: DataFrame, text: str = "text", band: Sequence[float] = BAND) -> DataFrame:
    """Fingerprints of all documents, of their edited texts and how like they are to the next document.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next document
    in descending doc_id; null ids come last, equal ids go by text hash, the last document is followed by the first,
    and rows with equal id and text count as one document in this order. A null text is empty. Other columns are
    ignored.
    """
    plain = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = Lexicon(lexicon(plain, "text", band))
    half = F.floor(F.char_length("text") / 2).cast("int")
    marked = plain.withColumn("m", F.xxhash64("text"))
    chain = written(neighbours(marked.select("d", "m", half.alias("half"))), "neighbours")
    # Texts are fingerprinted once; after that, only prints and ids are joined to the chain.
    prints = written(marked.select("d", "m", fingerprint(F.col("text"), known).alias("fp")).dropDuplicates(["d", "m"]), "prints")
    thin = chain.join(prints, ["d", "m"])
    following = thin.select(F.col("pd").alias("d"), F.col("pm").alias("m"), F.col("fp").alias("next_fp"))
    printed = marked.join(thin.select("d", "m", "fp").join(following, ["d", "m"]), ["d", "m"])
    once = Window.partitionBy("d", "m").orderBy("half")
    gifts = (
        marked.join(chain, ["d", "m"])
        .withColumn("rank", F.row_number().over(once))
        .where("rank = 1")
        .select(F.col("pd").alias("d"), F.col("pm").alias("m"), F.col("text").substr(F.lit(1), F.col("half")).alias("gift"))
    )
    n = F.char_length("text")
    joined = printed.join(gifts, ["d", "m"])
    edited = joined.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - half), "gift"))
    final = edited.select(
        F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"),
        n.cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fp",
        fingerprint(F.col("edited"), known).alias("edited_fp"),
        "next_fp",
    )
    return final.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        spelled(F.col("fp")).alias("fingerprint"),
        spelled(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op3_imatch(spark, sf_dir: str) -> DataFrame:
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
