"""Metric stand-ins: which counters, histograms and gauges the request view emits.

Label and value texts are read alike by both dialects.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.operators import metrics as m
from assayer.plans import standins

RESTART_S = 7200  # every two hours of metric time the emitting process restarts
MS_BOUNDS = (50.0, 250.0, 1000.0, 2500.0, 5000.0, 10000.0, 20000.0, 40000.0)
S_BOUNDS = (0.25, 1.0, 2.5, 5.0, 10.0, 20.0, 40.0)


@dataclass(frozen=True)
class Spec:
    kind: str  # counter, histogram or gauge
    labels: dict[str, str] = field(default_factory=dict)
    value: str = "1"
    where: str = "TRUE"
    bounds: tuple[float, ...] = ()
    tick: int = 15


def counter(value: str = "1", where: str = "TRUE", tick: int = 15, **labels: str) -> Spec:
    return Spec("counter", labels, value, where, (), tick)


def histogram(value: str, bounds: tuple[float, ...], where: str = "TRUE", tick: int = 15, **labels: str) -> Spec:
    return Spec("histogram", labels, value, where, bounds, tick)


def gauge(value: str, where: str = "TRUE", tick: int = 15, **labels: str) -> Spec:
    return Spec("gauge", labels, value, where, (), tick)


SECONDS = "CAST(latency_ms AS DOUBLE) / 1000"
POD = "concat(team, '-api-', user_id % 7)"
NODE = "concat('node-', user_id % 5)"
VLLM = dict(app="app", job="'vllm-models'")
# All model servers run in one namespace, so a panel of that namespace shows all of them.
SPACED = dict(app="app", namespace="'llm-baseline'")
HARNESS = dict(team="team", scenario_id="scenario_id", bucket="bucket", variant="variant_id")
MODEL = dict(team="team", variant_id="variant_id", variant_type="variant_type", bucket="bucket")
GIB = "CAST(1073741824 AS BIGINT)"

METRICS: dict[str, Spec] = {
    # gateway
    "gateway_requests_total": counter(team="team", status="status_code"),
    "lab_gateway_requests_total": counter(
        team="team", target_team="team",
        decision="CASE WHEN k % 10 = 0 THEN 'fallback' ELSE 'direct' END",
        ab_bucket="CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END",
    ),
    "gateway_outcomes_total": counter(team="team", status="status"),
    "gateway_latency_ms": histogram("latency_ms", MS_BOUNDS, team="team"),
    "http_server_request_count_total": counter(
        service_name="concat(team, '-api')", http_status_code="status_code"
    ),
    "http_server_request_duration_seconds": histogram(SECONDS, S_BOUNDS, service_name="concat(team, '-api')"),
    "sagemaker_invoke_duration_seconds": histogram(SECONDS, S_BOUNDS, endpoint="concat(team, '-endpoint')"),
    "sagemaker_invoke_errors_total": counter(
        where="status <> 'success'", endpoint="concat(team, '-endpoint')", error_type="status"
    ),
    # team services
    "lab_service_requests_total": counter(
        team="team", variant_id="variant_id", status_code="status_code", kubernetes_pod_name=POD
    ),
    "lab_llm_e2e_duration_ms": histogram("latency_ms", MS_BOUNDS, **MODEL),
    "genai_usage_output_tokens_total": counter("k", team="team", variant_id="variant_id"),
    "lab_llm_inflight_requests": gauge("k % 12", team="team", scenario_id="scenario_id"),
    # harness
    "lab_harness_requests_total": counter(**HARNESS),
    "lab_harness_pass_total": counter(where="status = 'success'", **HARNESS),
    "lab_harness_fail_total": counter(where="status <> 'success'", **HARNESS),
    "lab_harness_latency_ms": histogram("latency_ms", MS_BOUNDS, **HARNESS),
    "lab_harness_last_latency_ms": gauge("latency_ms", team="team", scenario_id="scenario_id", bucket="bucket"),
    "lab_llm_last_duration_ms": gauge("latency_ms - latency_ms // 5", team="team", bucket="bucket"),
    # model servers
    "vllm:request_success_total": counter(where="status = 'success'", tick=10, **VLLM),
    "vllm:generation_tokens_total": counter("k", where="status = 'success'", tick=10, **VLLM),
    "vllm:e2e_request_latency_seconds": histogram(SECONDS, S_BOUNDS, tick=10, **VLLM),
    "vllm:time_to_first_token_seconds": histogram(SECONDS + " / 8", S_BOUNDS, tick=10, **VLLM),
    "vllm:time_per_output_token_seconds": histogram(SECONDS + " / 64", (0.05, 0.1, 0.25, 0.5, 1.0), tick=10, **VLLM),
    "vllm:avg_generation_throughput_toks_per_s": gauge("k", tick=10, **VLLM),
    "vllm:gpu_cache_usage_perc": gauge("CAST(k AS DOUBLE) / 128", tick=10, **VLLM),
    "vllm:num_requests_running": gauge("k % 9", tick=10, **VLLM),
    "vllm:num_requests_waiting": gauge("k % 17", tick=10, **VLLM),
    "up": gauge("CASE WHEN status = 'error' THEN 0 ELSE 1 END", tick=10, **VLLM),
    # the same servers as the scaler and the model dashboard name them, by namespace
    "vllm_num_requests_waiting": gauge("k % 17", tick=10, **SPACED),
    "vllm_gpu_cache_usage_perc": gauge("CAST(k AS DOUBLE) / 128", tick=10, **SPACED),
    "vllm_request_success_total": counter(where="status = 'success'", tick=10, **SPACED),
    "vllm_e2e_request_latency_seconds": histogram(SECONDS, S_BOUNDS, tick=10, **SPACED),
    "vllm_time_to_first_token_seconds": histogram(SECONDS + " / 8", S_BOUNDS, tick=10, **SPACED),
    "vllm_request_generation_tokens": histogram("k", (8.0, 32.0, 64.0), where="status = 'success'", tick=10, **SPACED),
    # cluster
    "kube_node_info": gauge("1", node=NODE),
    "kube_namespace_created": gauge("1", namespace="team"),
    "kube_deployment_created": gauge("1", namespace="team", deployment="concat(team, '-api')"),
    "kube_deployment_spec_replicas": gauge("3", namespace="team", deployment="concat(team, '-api')"),
    "kube_deployment_status_replicas_available": gauge("k % 4", namespace="team", deployment="concat(team, '-api')"),
    "kube_deployment_status_replicas_unavailable": gauge("3 - k % 4", namespace="team", deployment="concat(team, '-api')"),
    "kube_pod_status_phase": gauge(
        "CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END",
        namespace="team", pod=POD,
        phase="CASE status WHEN 'success' THEN 'Running' WHEN 'timeout' THEN 'Pending' ELSE 'Failed' END",
    ),
    "kube_pod_status_ready": gauge(
        "CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END", namespace="team", pod=POD,
        condition="CASE status WHEN 'success' THEN 'true' ELSE 'false' END",
    ),
    "kube_pod_container_status_restarts_total": counter(where="event_type = 'signup'", namespace="team", pod=POD),
    "kube_resourcequota": gauge(f"64 * {GIB}", namespace="team", resource="'limits.memory'"),
    "container_cpu_usage_seconds_total": counter(
        "latency_ms", namespace="team", image="CASE WHEN k % 5 = 0 THEN '' ELSE 'api:1' END"
    ),
    "container_memory_working_set_bytes": gauge(
        "latency_ms * 1024", namespace="team", pod=POD, image="CASE WHEN k % 5 = 0 THEN '' ELSE 'api:1' END"
    ),
    "container_memory_usage_bytes": gauge("latency_ms * 2048", namespace="team", pod=POD),
    "node_cpu_seconds_total": counter("k", node=NODE, cpu="CAST(k % 3 AS VARCHAR(1))", mode="CASE WHEN k % 2 = 0 THEN 'idle' ELSE 'user' END"),
    "node_memory_MemAvailable_bytes": gauge("latency_ms * 65536", instance=NODE),
    "node_memory_MemTotal_bytes": gauge(f"16 * {GIB}", instance=NODE),
    "node_filesystem_avail_bytes": gauge("latency_ms * 1048576", instance=NODE, mountpoint="'/'", fstype="CASE WHEN k % 6 = 0 THEN 'rootfs' ELSE 'ext4' END"),
    "node_filesystem_size_bytes": gauge(f"64 * {GIB}", instance=NODE, mountpoint="'/'", fstype="CASE WHEN k % 6 = 0 THEN 'rootfs' ELSE 'ext4' END"),
    "node_network_receive_bytes_total": counter("latency_ms", instance=NODE, device="CASE k % 4 WHEN 0 THEN 'lo' WHEN 1 THEN 'veth1' ELSE 'eth0' END"),
    "node_network_transmit_bytes_total": counter("latency_ms", instance=NODE, device="CASE k % 4 WHEN 0 THEN 'lo' WHEN 1 THEN 'veth1' ELSE 'eth0' END"),
    "node_load1": gauge("CAST(k AS DOUBLE) / 16", instance=NODE),
}


def spec_of(metric: str) -> tuple[Spec, str]:
    """Spec and part (value, bucket, sum or count) of a metric name."""
    for suffix in ("bucket", "sum", "count"):
        base = metric.removesuffix(f"_{suffix}")
        if base != metric and base in METRICS and METRICS[base].kind == "histogram":
            return METRICS[base], suffix
    return METRICS[metric], "value"


def series_of(metric: str) -> list[str]:
    spec, part = spec_of(metric)
    return list(spec.labels) + (["le"] if part == "bucket" else [])


def samples(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    """Samples (labels, t, value) of one metric, emitted from the request view."""
    spec, part = spec_of(metric)
    value = spec.value.replace(" // ", " div ")
    events = standins.requests(spark, sf_dir).where(spec.where).selectExpr(
        *[f"{expr} AS {name}" for name, expr in spec.labels.items()],
        f"{value} AS v",
        "request_id AS seq",
        "fast_us div 1000000 AS s",
    )
    labels, t = list(spec.labels), F.col("s")
    if spec.kind == "gauge":
        return events.groupBy(*labels, m.step_of(t, spec.tick).alias("t")).agg(
            F.max_by("v", "seq").cast("double").alias("value")
        )
    if part == "bucket":
        deltas = m.emit_histogram(events, labels, F.col("v"), spec.bounds, t, spec.tick)
    else:
        deltas = m.emit_counter(events, labels, t, spec.tick, 1 if part == "count" else F.col("v"))
    return m.accumulate(deltas, series_of(metric), RESTART_S)


def samples_sql(metric: str) -> str:
    """The same samples as SQL over the request view."""
    spec, part = spec_of(metric)
    labels = ", ".join(f"{expr} AS {name}" for name, expr in spec.labels.items())
    names = "".join(f"{n}, " for n in spec.labels)
    base = (
        f"SELECT {labels}, {spec.value} AS v, request_id AS seq, fast_us // 1000000 // {spec.tick} * {spec.tick} AS t"
        f" FROM requests WHERE {spec.where}"
    )
    if spec.kind == "gauge":
        return f"SELECT {names}t, arg_max(v, seq)::DOUBLE AS value FROM ({base}) e GROUP BY {names}t"
    if part == "bucket":
        les = ", ".join([f"'{m.le_text(b)}'" for b in spec.bounds] + ["'inf'"])
        delta = (
            f"SELECT {names}replace(le, 'inf', '+Inf') AS le, t, count(*) FILTER (v <= le::DOUBLE) AS d FROM ({base}) e,"
            f" (SELECT unnest([{les}]) AS le) b GROUP BY {names}le, t"
        )
        names += "le, "
    else:
        inc = "1" if part == "count" else "v"
        delta = f"SELECT {names}t, sum({inc}) AS d FROM ({base}) e GROUP BY {names}t"
    return (
        f"SELECT {names}t, (sum(d) OVER (PARTITION BY {names}t // {RESTART_S} ORDER BY t))::DOUBLE AS value"
        f" FROM ({delta}) x"
    )
