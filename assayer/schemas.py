"""Explicit schemas; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PROMPT = _struct(
    prompt_id=_S,
    prompt=_S,
    scenario_id=_S,
    dataset_id=_S,
    expected_contains=T.ArrayType(_S),
    expected_format=_S,
    target_output_tokens=_L,
    bucket=_S,
    category=_S,
    split=_S,
    metadata=T.MapType(_S, _S),
)

MANIFEST = _struct(
    promptset_id=_S,
    scenario_id=_S,
    dataset_id=_S,
    created_at=_S,
    seed=_L,
    prompt_count=_L,
    expected_output_schema=_struct(format=_S),
    target_buckets=_struct(
        input_tokens=_struct(min=_L, max=_L), output_tokens=_struct(buckets=T.ArrayType(_L))
    ),
    checksum=_S,
    version=_S,
    compatible_harness_version=_S,
)

RUBRIC = _struct(
    eval_id=_S,
    prompt=_S,
    response_candidate=_S,
    reference_context=_S,
    ground_truth=_S,
    context_document=_S,
    ground_truth_answer=_S,
    factuality_checkable=_B,
    expected_scores=T.MapType(_S, _D),
)

ROUTES = T.MapType(
    _S,
    _struct(url=_S, timeout_ms=_L, ab_variants=T.MapType(_S, _struct(weight=_L))),
)

SPAN = _struct(
    trace_id=_S,
    span_id=_S,
    parent_span_id=_S,
    name=_S,
    service=_S,
    start_ts=T.TimestampType(),
    end_ts=T.TimestampType(),
    resource=T.MapType(_S, _S),
    attributes=T.MapType(_S, _S),
    events=T.ArrayType(_struct(name=_S, attributes=T.MapType(_S, _S))),
)

SAMPLE = _struct(metric=_S, labels=T.MapType(_S, _S), ts=T.TimestampType(), value=_D)

LOG_FIXED = ["timestamp", "severity", "message", "logger", "service.name", "lab.team", "trace_id", "span_id"]
