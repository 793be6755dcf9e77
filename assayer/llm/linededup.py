"""Near-duplicate lines across documents by a deletion-neighbourhood join (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from assayer.llm.columns import packed, unpacked
from assayer.llm.linehash import Lines, name
from assayer.llm.tables import written

MIN_CHARS = 20  # shorter lines are left alone: within one edit, they need not say the same
AT_ONCE = 1 << 20  # code points hashed at a time
FILTER_BITS = 1 << 26
PAGE = 32768  # bits of one bitmap of bitmap_construct_agg
NO_ID = -(2**63)

LINE = "d long, m long, line int, n int, h long, g long, k0 long, k1 long, k2 long, k3 long"
CANDIDATE = "d long, m long, line int, text string"
VARIANT = "v long, i int, lid long, d long, m long, line int"


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _batches(docs: pd.DataFrame, min_chars: int) -> Iterator[tuple[list[tuple[int, int, int]], list[str]]]:
    """(places, normalised lines) of all lines that count, a bounded number of code points at a time."""
    places, lines, held = [], [], 0
    for d, m, text in zip(docs["d"].tolist(), docs["m"].tolist(), docs["text"]):
        for i, line in enumerate(text.split("\n")):
            if len(line) >= min_chars:
                places.append((d, m, i + 1))
                lines.append(line.strip().lower())
                held += len(line)
                if held >= AT_ONCE:
                    yield places, lines
                    places, lines, held = [], [], 0
    if lines:
        yield places, lines


def _hashed(min_chars: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for docs in frames:
            for places, lines in _batches(docs, min_chars):
                sums = Lines(lines)
                out = dict(zip(("d", "m", "line"), np.array(places, np.int64).T))
                out |= {"n": sums.size, "h": _signed(name(sums.whole(), sums.size))}
                out["g"] = _signed(np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines), np.uint64, len(lines)))
                out |= {f"k{i}": _signed(k) for i, k in enumerate(sums.halves())}
                yield pd.DataFrame(out)

    return run


def _candidates(min_chars: int, bits: np.ndarray):
    """Lines whose hash the filter holds, with their text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for docs in frames:
            for places, lines in _batches(docs, min_chars):
                sums = Lines(lines)
                at = (name(sums.whole(), sums.size) % np.uint64(FILTER_BITS)).astype(np.int64)
                hit = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                yield pd.DataFrame([(*places[i], lines[i]) for i in hit], columns=["d", "m", "line", "text"])

    return run


def _variants(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each line's own hash (i = -1) and those of its one-deletion variants (i = the place deleted).

    A line that shares only its first half with another keeps that half in every match, so places in it are left out;
    likewise for the last half.
    """
    for batch in frames:
        lines = batch["text"].tolist()
        at = 0
        while at < len(lines):
            stop, held = at, 0
            while stop < len(lines) and held < AT_ONCE // 4:
                held += len(lines[stop])
                stop += 1
            part, sums = batch.iloc[at:stop], Lines(lines[at:stop])
            line, hashes = sums.without()
            half = np.maximum(sums.size - 1, 0)[line] // 2
            first, last = part["p"].to_numpy(bool)[line], part["s"].to_numpy(bool)[line]
            used = (last & (sums.place < sums.size[line] - half)) | (first & (sums.place >= half))
            line, hashes, place = line[used], hashes[used], sums.place[used]
            rows = np.concatenate([np.arange(len(part)), line])
            yield pd.DataFrame({
                "v": _signed(np.concatenate([name(sums.whole(), sums.size), name(hashes, sums.size[line] - 1)])),
                "i": np.concatenate([np.full(len(part), -1), place]).astype(np.int32),
                **{c: part[c].to_numpy()[rows] for c in ("lid", "d", "m", "line")},
            })
            at = stop


def _filter_of(flagged: DataFrame) -> np.ndarray:
    """A bitmap of the flagged hashes: FILTER_BITS / 8 bytes, whatever the number of lines."""
    # Hashes are unsigned in tasks; a signed one has the same remainder modulo a power of two.
    bit = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    pages = flagged.select(F.bitmap_bucket_number(bit).alias("page"), F.bitmap_bit_position(bit).alias("bit"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in pages.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        at = (row["page"] - 1) * PAGE // 8
        bits[at : at + PAGE // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return bits


def _earlier(variants: DataFrame) -> DataFrame:
    """(lid, other): for each line with an earlier one that shares a variant with it, the earliest such.

    Lines that lose the same place to a variant differ by a substitution, a line that is another's variant by an
    insertion. Only minima are taken, so no pairs of a group are formed.
    """
    own = F.struct("d", "m", "line", "lid")
    same, any_ = Window.partitionBy("v", "i"), Window.partitionBy("v")
    whole = F.min(F.when(F.col("i") < 0, own)).over(any_)
    partial = F.min(F.when(F.col("i") >= 0, own)).over(any_)
    met = variants.select("lid", own.alias("own"), F.when(F.col("i") < 0, F.least(whole, partial)).otherwise(F.least(F.min(own).over(same), whole)).alias("other"))
    return met.where("other < own").groupBy("lid").agg(F.min("other").alias("o")).select("lid", F.col("o.lid").alias("other"))


def kept_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(d, m, kept): by document, the numbers of its lines that count and stay; ``docs`` has d, m and text."""
    lines = docs.mapInPandas(_hashed(min_chars), LINE)
    rest = ("n", "k0", "k1", "k2", "k3")
    first = lines.groupBy("h", "g").agg(F.min(F.struct("d", "m", "line", *rest)).alias("f"))
    distinct = written(first.select("h", "g", "f.*").withColumn("lid", F.monotonically_increasing_id()), "lines")

    keys = F.array(*[F.struct(F.col(f"k{i}").alias("key"), F.lit(i % 2).alias("kind")) for i in range(4)])
    keyed = distinct.select("lid", F.inline(keys))
    shared = keyed.groupBy("key").count().where("count > 1").select("key")
    flags = keyed.join(shared, "key").groupBy("lid").agg(F.max(F.col("kind") == 0).alias("p"), F.max(F.col("kind") == 1).alias("s"))
    flagged = written(distinct.join(flags, "lid").select("lid", "h", "d", "m", "line", "p", "s"), "flagged-lines")

    found = docs.mapInPandas(_candidates(min_chars, _filter_of(flagged)), CANDIDATE)
    texts = written(found.join(flagged, ["d", "m", "line"]).dropDuplicates(["lid"]), "line-texts")
    pairs = _earlier(texts.mapInPandas(_variants, VARIANT))
    one = texts.select("lid", F.col("text").alias("a"))
    two = texts.select(F.col("lid").alias("other"), F.col("text").alias("b"))
    within = F.levenshtein("a", "b", 1).between(0, 1)
    dropped = pairs.join(one, "lid").join(two, "other").where(within).select("lid")
    kept = distinct.join(dropped, "lid", "left_anti")
    return kept.groupBy("d", "m").agg(F.collect_list("line").alias("kept"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The input with its text's repeated lines taken out, and ``n_lines`` and ``n_dropped``.

    A line goes if an earlier one, by doc_id and then line number, is equal to it or within one edit (a code point
    put in, taken out or changed), white space at its ends and case aside. Lines of fewer than ``min_chars`` code
    points are left alone. Null ids come first; rows with equal id and text count as one document and get the same
    answer. A null text has no lines and stays null. Input columns that bear an output's name are replaced.

    Lines within one edit share their first or last half, so the halves' hashes flag the few lines that need variants
    before any is made. All joins are on hashes or line numbers; texts are shuffled once, at the end.
    """
    own = docs.select(
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("m"), F.col(text).alias("text")
    )
    kept = kept_lines(own.where("text IS NOT NULL"), min_chars)
    named = packed(docs, d=F.coalesce(docs[f"`{doc_id}`"].cast("bigint"), F.lit(NO_ID)), m=F.xxhash64(docs[f"`{text}`"]))
    joined = named.join(kept, ["d", "m"], "left")
    split = joined.withColumn("lines", F.split(F.col("row").getField(text), "\n"))
    short = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.char_length(F.element_at("lines", i)) < min_chars)
    stay = F.sort_array(F.array_union(short, F.coalesce("kept", F.array().cast("array<int>"))))
    out = split.withColumn("stay", F.when(F.col("lines").isNotNull(), stay)).select(
        "row",
        F.array_join(F.transform("stay", lambda i: F.element_at("lines", i)), "\n").alias(text),
        F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size("stay")).cast("bigint").alias("n_dropped"),
    )
    out = out.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    added = ("n_lines", "n_dropped")
    return unpacked(out, text, *added).select(*[c for c in docs.columns if c.lower() not in added], *added)


def cleaned(docs: DataFrame) -> DataFrame:
    """Documents with their repeated lines taken out and ``n_chars`` renewed, with the input's own columns."""
    out = dedup(docs)
    renewed = {c: F.char_length("text").cast(docs.schema[c].dataType) for c in docs.columns if c == "n_chars"}
    return out.withColumns(renewed).select(*docs.columns) if renewed else out.select(*docs.columns)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select(
        "doc_id", "n_lines", "n_dropped", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")
    )
