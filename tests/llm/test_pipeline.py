from __future__ import annotations

import __spark_entry__ as entry
import corpus_pipeline
from assayer.llm import packing


def test_queries_are_registered():
    names = {n.split("_")[0] for n in entry.queries()}
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= names


def test_each_stage_keeps_columns_and_takes_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert len(corpus_pipeline.STAGES) == 5
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns
        kept.append(docs.count())
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert before >= kept[0] > kept[1] == kept[2] > kept[3] > 0
    texts = [r["text"] for r in docs.collect()]
    cache = packing.WordCache(packing.tokenizer_path())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sum(r["length"] for r in pieces) == sum(len(x) + 1 for x in cache.encode(texts))


def test_an_empty_table_passes_every_stage(spark, none, sf):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
