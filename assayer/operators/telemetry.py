"""Spans: derived attributes, redaction, conformance, trees and correlation with logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.hashing import bucket_of, short_hash
from assayer.functions.numbers import fold_bool, metric_div, py_round

# Share of traces with detail events, in ten-thousandths; defaults of the resource.
DETAIL_SHARE = 100
RESOURCE_DEFAULTS = {
    "service.version": "0.1.0",
    "deployment.environment": "dev",
    "k8s.cluster.name": "unknown",
    "k8s.pod.name": "unknown",
    "cloud.provider": "aws",
    "cloud.region": "us-west-2",
    "lab.owner": "platform",
}
# Keys every span of a component carries, and keys due under a condition.
REQUIRED = {
    "gateway": (
        "lab.route.target.team",
        "lab.route.decision",
        "lab.route.reason",
        "lab.route.policy.id",
        "lab.backend.retries",
        "lab.backend.timeout.ms",
    ),
    "service": (
        "lab.model.variant.type",
        "lab.model.variant.id",
        "genai.usage.input_tokens",
        "genai.usage.output_tokens",
        "lab.sagemaker.endpoint.name",
    ),
}
CONDITIONAL = (
    ("gateway", "lab.ab.enabled", "true", "lab.ab.bucket"),
    ("service", "lab.streaming", "true", "lab.llm.ttft.ms"),
    ("service", "lab.streaming", "true", "lab.llm.tpot.ms"),
    ("service", "lab.status", "error", "error.type"),
)
# Attributes with a closed set of values.
ENUMS = {
    "lab.request.kind": ("predict", "score", "health"),
    "lab.route.target.team": ("quant", "finetune", "eval"),
    "lab.route.decision": ("direct", "fallback", "deny"),
    "lab.route.reason": ("explicit_path", "ab_bucket", "backend_unready", "circuit_open", "quota_guardrail"),
    "lab.model.intent": ("quantized", "finetuned", "evaluator"),
    "error.type": ("timeout", "http_5xx", "connection_refused"),
}
# What never belongs on metrics and logs.
FORBIDDEN_KEYS = ("prompt", "response", "user.id", "user.email")
MAX_VALUE_CHARS = 200


def attr(name: str, default: str | None = None) -> Column:
    value = F.try_element_at(F.col("attributes"), F.lit(name))
    return value if default is None else F.coalesce(value, F.lit(default))


def genai_metrics(calls: DataFrame) -> DataFrame:
    """Totals and speeds from (input_tokens, output_tokens, duration_ms).

    Speeds exist only where something was generated; unknown counts stay null. Tokens that took no measurable time have
    an infinite speed.
    """
    out, ms = F.col("output_tokens"), F.col("duration_ms").cast("double")
    made = (out > 0) & (ms >= 0)
    return calls.withColumns(
        {
            "total_tokens": F.col("input_tokens") + out,
            "tpot_ms": F.when(made, (ms / out).cast("bigint")),
            "tokens_per_sec": F.when(made, py_round(metric_div(out, ms) * 1000, 1)),
        }
    )


def ttft_ms(start_us: Column, first_token_us: Column) -> Column:
    """Whole milliseconds to the first token; null without one."""
    return F.floor((first_token_us - start_us) / 1000).cast("bigint")


def resource_attributes(df: DataFrame, given: Mapping[str, Column], service: Column, namespace: Column) -> DataFrame:
    """The twelve resource keys as a map, defaults where nothing is given."""
    values = {
        "service.name": service,
        "service.namespace": namespace,
        "service.instance.id": F.concat(service, F.lit("-local")),
        "k8s.namespace.name": namespace,
        "lab.team": namespace,
        **{k: F.lit(d) for k, d in RESOURCE_DEFAULTS.items()},
    }
    entries: list[Column] = []
    for key, default in values.items():
        entries += [F.lit(key), F.coalesce(given[key], default) if key in given else default]
    return df.withColumn("resource", F.create_map(*entries))


def sampled(trace_id: Column, share: int = DETAIL_SHARE) -> Column:
    """One decision per trace, so prompt and completion are kept or dropped together."""
    return bucket_of(trace_id, 10000) < share


def redact(calls: DataFrame, share: int = DETAIL_SHARE) -> DataFrame:
    """Raw texts out, hashed detail events in, the events only on sampled traces."""

    def event(kind: str) -> Column:
        return F.struct(
            F.lit(f"genai.{kind}").alias("name"),
            F.create_map(
                F.lit(f"genai.{kind}.hash"),
                short_hash(F.col(kind)),
                F.lit("lab.redaction.applied"),
                F.lit("true"),
                F.lit("lab.payload.encrypted_ref"),
                F.coalesce(f"{kind}_ref", F.lit("not_stored")),
            ).alias("attributes"),
        )

    both = F.array(event("prompt"), event("completion"))
    kept = F.when(sampled(F.col("trace_id"), share), both).otherwise(F.filter(both, lambda _: F.lit(False)))
    return calls.withColumn("events", kept).drop("prompt", "completion", "prompt_ref", "completion_ref")


def missing_attributes(spans: DataFrame) -> DataFrame:
    """Adds ``missing``: required keys the span lacks, conditional ones included."""
    keys = F.map_keys("attributes")
    required = F.array().cast("array<string>")
    for component, names in REQUIRED.items():
        required = F.when(F.col("component") == component, F.array(*[F.lit(n) for n in names])).otherwise(required)
    due = [
        F.when((F.col("component") == component) & (attr(flag) == value), F.lit(key))
        for component, flag, value, key in CONDITIONAL
    ]
    everything = F.concat(required, F.array_compact(F.array(*due)))
    return spans.withColumn("missing", F.array_except(everything, keys))


def enum_violations(spans: DataFrame) -> DataFrame:
    """Rows (key, value, spans): attribute values outside their closed set, counted."""
    bad = F.array_compact(
        F.array(
            *[
                F.when(attr(key).isNotNull() & ~attr(key).isin(*allowed), F.struct(F.lit(key).alias("key"), attr(key).alias("value")))
                for key, allowed in ENUMS.items()
            ]
        )
    )
    return spans.select(F.inline(bad)).groupBy("key", "value").agg(F.count(F.lit(1)).alias("spans"))


def raw_text_guard(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of forbidden keys and overlong values in ``attributes``."""
    forbidden = F.exists(F.map_keys("attributes"), lambda k: k.isin(*FORBIDDEN_KEYS))
    overlong = F.exists(F.map_values("attributes"), lambda x: F.length(x) > MAX_VALUE_CHARS)
    return signals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("signals"),
        F.sum(fold_bool(forbidden)).alias("forbidden_key"),
        F.sum(fold_bool(overlong)).alias("overlong_value"),
    )


def baggage(values: Mapping[str, Column]) -> Column:
    """Propagated keys, only those that are set."""
    entries = [x for k, c in values.items() for x in (F.lit(k), c)]
    return F.map_filter(F.create_map(*entries), lambda _, x: x.isNotNull() & (x != ""))


def baggage_header(bag: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(bag), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def parse_baggage(header: Column) -> Column:
    return F.str_to_map(header, F.lit(","), F.lit("="))


def service_edges(spans: DataFrame) -> DataFrame:
    """Calls, errors and time between services, from parent and child spans.

    A span id is unique within its trace, so a parent with very many children is hot on the child
    side only, where AQE splits it.
    """
    parents = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("from_service"))
    children = spans.where(F.col("parent_span_id").isNotNull())
    return (
        children.join(parents, ["trace_id", "parent_span_id"])
        .groupBy("from_service", F.col("service").alias("to_service"))
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum(fold_bool(F.col("status") == "error")).alias("errors"),
            F.sum(F.col("end_us") - F.col("start_us")).alias("total_us"),
        )
    )


def trace_summary(spans: DataFrame) -> DataFrame:
    """One row per trace, built by mergeable aggregates."""
    return spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("spans"),
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        F.sum(fold_bool(F.col("status") == "error")).alias("errors"),
    )


def logs_with_traces(lines: DataFrame, traces: DataFrame) -> DataFrame:
    """Log lines with the trace their text names; ``traces`` has one row per trace."""
    found = F.get(F.regexp_extract_all("line", F.lit('"trace_id":"([^"]+)"'), 1), F.lit(0))
    return lines.withColumn("trace_id", found).join(traces, "trace_id")


def logs_in_spans(spans: DataFrame, logs: DataFrame, slot_us: int = 60_000_000) -> DataFrame:
    """Logs of the same service and pod within a span's time.

    Time is cut into slots first: a busy pod is spread over its slots, and only rows that share a
    slot meet.
    """
    slotted = spans.withColumn(
        "_slot", F.explode(F.sequence(F.floor(F.col("start_us") / slot_us), F.floor(F.col("end_us") / slot_us)))
    )
    keyed = logs.withColumn("_slot", F.floor(F.col("ts_us") / slot_us))
    return slotted.join(keyed, ["service", "pod", "_slot"]).where(
        (F.col("ts_us") >= F.col("start_us")) & (F.col("ts_us") <= F.col("end_us"))
    ).drop("_slot")


def enrich(signals: DataFrame, pods: DataFrame, environment: str) -> DataFrame:
    """Pod metadata upserted into the resource map; signals of unknown pods stay as they are."""
    meta = pods.select("pod", F.col("metadata").alias("_meta"))
    base = F.create_map(F.lit("deployment.environment"), F.lit(environment))
    empty = F.map_filter(base, lambda k, _: k.isNull())
    return (
        signals.join(meta, "pod", "left")
        .withColumn("resource", F.map_concat("resource", base, F.coalesce("_meta", empty)))
        .drop("_meta")
    )


def search(spans: DataFrame, resource: Mapping[str, str], span: Mapping[str, str]) -> DataFrame:
    """Spans whose resource and span attributes have all the given values."""
    cond = F.lit(True)
    for where, wanted in (("resource", resource), ("attributes", span)):
        for key, value in wanted.items():
            cond = cond & (F.try_element_at(F.col(where), F.lit(key)) == value)
    return spans.where(cond)
