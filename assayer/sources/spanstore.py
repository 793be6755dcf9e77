"""A table of spans made for search: promoted columns, files in the order of trace ids, Bloom filters for the rest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

# Attributes that searches name, and the columns they become.
PROMOTED = {
    "resource": {"service.name": "service_name", "lab.team": "lab_team"},
    "attributes": {
        "lab.run.id": "lab_run_id",
        "lab.scenario.id": "lab_scenario_id",
        "lab.model.variant.id": "lab_model_variant_id",
        "genai.request.model": "genai_request_model",
    },
}
FILTERED = ("trace_id", "span_id", "lab_run_id")  # columns with many values, found by Bloom filter
ROW_GROUP_BYTES = 16 << 20


def write_spans(spans: DataFrame, path: str, start: Column, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Store spans by day; ``start`` is a span's start as a timestamp.

    Promoted attributes stand in columns of their own beside the maps, which stay whole. Rows are dealt out and sorted by
    trace id, so that a trace lies in few row groups, whose statistics tell them apart; row groups carry Bloom filters
    for ids that the order does not help. Writing a day again replaces it.
    """
    columns = {c: F.try_element_at(where, F.lit(key)) for where, keys in PROMOTED.items() for key, c in keys.items()}
    dated = spans.withColumns(columns).withColumn("date", F.to_date(start))
    writer = (
        dated.repartitionByRange("date", "trace_id")
        .sortWithinPartitions("date", "trace_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.block.size", row_group_bytes)
    )
    for name in FILTERED:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.partitionBy("date").parquet(path)


def find(
    store: DataFrame,
    resource: Mapping[str, str] | None = None,
    attributes: Mapping[str, str] | None = None,
    dates: tuple[str, str] | None = None,
    **ids: str,
) -> DataFrame:
    """Stored spans that have all the given values.

    Promoted attributes, ids (trace_id, span_id) and days become conditions on columns, which reach the files: days
    prune folders, the others row groups. Attributes that are not promoted are looked up in the map of the rows left.
    """
    cond = F.lit(True)
    if dates:
        cond = cond & F.col("date").between(F.lit(dates[0]).cast("date"), F.lit(dates[1]).cast("date"))
    for name, value in ids.items():
        cond = cond & (F.col(name) == value)
    for where, wanted in (("resource", resource or {}), ("attributes", attributes or {})):
        for key, value in wanted.items():
            column = PROMOTED[where].get(key)
            cond = cond & ((F.col(column) if column else F.try_element_at(where, F.lit(key))) == value)
    return store.where(cond)
