"""SentencePiece encoding and decoding with a max-plus scan over the chunks of giant documents (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from assayer.llm.pieces import LEAD, breaks, cut_states, model_path, pieces, spelled
from assayer.llm.tables import written
from assayer.llm.wordbatch import slices

CHUNK = 1 << 15  # code points; longer texts are cut
WINDOW = 256  # code points after a cut's nominal place in which a break is looked for
CONTEXT = 64  # code points that a chunk sees beyond its cuts; at least the longest piece

SLICE = 1 << 21  # bytes of texts encoded at a time

CHUNKS = "row_id long, k int, last boolean, offset long, part string"


def _small(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path).model
        for batch in (some for whole in batches for some in slices(whole, "text", SLICE)):
            found = model.encode([t or "" for t in batch.column("text").to_pylist()], num_threads=1)
            columns = {"doc_id": batch.column("doc_id"), "ids": pa.array(found, pa.list_(pa.int32()))}
            if decoded:
                columns["decoded"] = pa.array([model.decode(ids) for ids in found], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _chunked(chunk: int):
    """Overlapping chunks of each text; a text is gone through once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                signs = spelled(batch.column("text")[row].as_py())
                count = -(-len(signs) // chunk)
                for k in range(count):
                    offset, last = max(0, k * chunk - CONTEXT), k == count - 1
                    part = signs[offset:] if last else signs[offset : (k + 1) * chunk + WINDOW + CONTEXT]
                    own = {"doc_id": batch.column("doc_id").slice(row, 1), "row_id": batch.column("row_id").slice(row, 1)}
                    numbers = {"k": pa.array([k], pa.int32()), "last": pa.array([last]), "offset": pa.array([offset], pa.int64())}
                    yield pa.RecordBatch.from_pydict(own | numbers | {"part": pa.array([part], pa.string())})

    return run


def _cuts(part: str, offset: int, k: int, last: bool, chunk: int) -> tuple[int, int]:
    """Places in ``part`` where the chunk starts and stops: the first break after the nominal place, or that place."""

    def cut(nominal: int) -> int:
        at = nominal - offset
        return next((c for c in range(at, min(at + WINDOW, len(part))) if breaks(part[c - 1], part[c])), at)

    return (0 if k == 0 else cut(k * chunk)), (len(part) if last else cut((k + 1) * chunk))


def _transfers(path: str, chunk: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces(path)
        for batch in frames:
            rows = []
            for row_id, k, last, offset, part in batch.itertuples(index=False):
                n, columns = model.transfer(part, *_cuts(part, offset, k, last, chunk))
                rows.append((row_id, k, n, [hex(c) for c in columns]))
            yield pd.DataFrame(rows, columns=["row_id", "k", "n", "columns"])

    return run


def _scanned(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("k")
    states = cut_states([(n, [int(c, 16) for c in columns]) for n, columns in zip(rows["n"], rows["columns"])])
    return pd.DataFrame({"row_id": rows["row_id"], "k": rows["k"], "entry": states[:-1], "exit": states[1:]})


def _traced(path: str, chunk: int, decoded: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces(path)
        lead = model.bytes[ord(LEAD)]
        for batch in frames:
            for row_id, k, last, offset, part, entry, exit_ in batch.itertuples(index=False):
                ids = model.traced(part, *_cuts(part, offset, k, last, chunk), entry, exit_)
                out = {"row_id": [row_id], "k": [k], "ids": [np.array(ids, np.int32)]}
                if decoded:  # behind another sign a chunk keeps the space it begins with
                    out["decoded"] = [model.model.decode(ids) if k == 0 else model.model.decode([lead, *ids])[len(LEAD) :]]
                yield pd.DataFrame(out)

    return run


def encode(
    docs: DataFrame, path: str | None = None, chunk: int = CHUNK, text: str = "text", doc_id: str = "doc_id", decoded: bool = False
) -> DataFrame:
    """(doc_id, ids) per document: the ids that the model's own encoder gives; with ``decoded`` also what they decode to.

    Texts up to ``chunk`` code points are encoded in place. Longer ones are cut into chunks that are dealt to all
    tasks; each yields a transfer matrix between what can stand at its cuts, the matrices of a document are combined,
    and each chunk is then traced back, and decoded, by itself. Null and empty texts have no ids; repeated rows are
    encoded each. Other columns are ignored. Chunks of giant texts are written to the shared folder.
    """
    path = path or model_path()
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    long_ = F.char_length("text") > chunk
    fields = _IDS + _DECODED * decoded
    few = own.where(~F.coalesce(long_, F.lit(False)))
    small = few.mapInArrow(_small(path, decoded), T.StructType([own.schema["doc_id"], *fields]))

    texts = own.where(long_).withColumn("row_id", F.monotonically_increasing_id())
    shape = T._parse_datatype_string(CHUNKS)
    chunks = texts.mapInArrow(_chunked(chunk), T.StructType([own.schema["doc_id"], *shape.fields]))
    chunks = written(chunks.repartition("row_id", "k"), "chunks")
    given = chunks.select(*shape.names)
    matrices = given.mapInPandas(_transfers(path, chunk), "row_id long, k int, n int, columns array<string>")
    # A document's chunks are as few as its length over the chunk's; a text fits a row.
    states = matrices.groupBy("row_id").applyInPandas(_scanned, "row_id long, k int, entry int, exit int")
    kinds = T.StructType([shape["row_id"], shape["k"], *fields])
    traced = given.join(states, ["row_id", "k"]).mapInPandas(_traced(path, chunk, decoded), kinds)
    parts = F.sort_array(F.collect_list(F.struct(*kinds.names)))
    joined = traced.groupBy("row_id").agg(parts.alias("parts"))
    whole = joined.select(
        "row_id",
        F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"),
        *[F.array_join(F.transform("parts", lambda x: x["decoded"]), "").alias("decoded")] * decoded,
    )
    giant = chunks.where("k = 0").select("doc_id", "row_id").join(whole, "row_id").drop("row_id")
    return small.unionByName(giant)


_IDS = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
_DECODED = [T.StructField("decoded", T.StringType())]


def _decoder(path: str):
    @F.pandas_udf(T.StringType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = pieces(path).model
        for batch in batches:
            yield batch.map(lambda ids: model.decode(ids.tolist()) if ids is not None else None)

    return decoded


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The input with ``text``, the decoded ``ids``; null ids give null, no ids the empty text."""
    return encoded.withColumn("text", _decoder(path or model_path())(F.col("ids")))


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, decoded=True).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_ids"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
