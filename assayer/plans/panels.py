"""Recording rules, dashboard panels and service statistics as data, and how each is evaluated.

Every panel is evaluated as a range: one value per group and step over the whole sample range.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.functions.labels import Match, all_match
from assayer.functions.numbers import metric_div
from assayer.operators import metrics as m
from assayer.plans import metric_standins as ms


@dataclass(frozen=True)
class Panel:
    """One rule or panel.

    kind: rate, rate_agg (rates per series, then ``agg``), increase, share (matching series over all), over (one metric over another),
    quantile, quantile_agg, instant, instant_agg, instant_over, minus, max_over_time.
    """

    name: str
    kind: str
    metric: str
    by: tuple[str, ...] = ()
    where: tuple[Match, ...] = ()
    num: tuple[Match, ...] = ()
    other: str | None = None
    other_where: tuple[Match, ...] | None = None
    window: int = 300
    step: int = 30
    q: float = 0.95
    agg: str = "sum"
    keep: str | None = None  # value filter
    post: str | None = None  # arithmetic on the value, read alike by both dialects
    covers: tuple[str, ...] = ()


def eq(label: str, value: str) -> Match:
    return Match(label, "=", value)


def re(label: str, value: str) -> Match:
    return Match(label, "=~", value)


def ne(label: str, value: str) -> Match:
    return Match(label, "!=", value)


def nre(label: str, value: str) -> Match:
    return Match(label, "!~", value)


# ---- evaluation --------------------------------------------------------------------------------


def evaluate(p: Panel, sample_table) -> DataFrame:
    """Rows (labels, eval_t, value); ``sample_table(metric)`` yields the samples of a metric."""
    by = list(p.by)

    def kept(metric: str, where: tuple[Match, ...]) -> tuple[DataFrame, list[str]]:
        return sample_table(metric).where(all_match(where)), ms.series_of(metric)

    def inc(metric: str, where: tuple[Match, ...], labels: list[str]) -> DataFrame:
        return m.increase(*kept(metric, where), labels, p.window, p.step)

    def vector(metric: str, where: tuple[Match, ...]) -> DataFrame:
        return m.instant(*kept(metric, where), p.step)

    other_where = p.where if p.other_where is None else p.other_where
    if p.kind == "rate":
        out = m.rate(*kept(p.metric, p.where), by, p.window, p.step)
    elif p.kind == "rate_agg":
        samples, series = kept(p.metric, p.where)
        out = m.aggregate(m.rate(samples, series, series, p.window, p.step), p.agg, by)
    elif p.kind == "increase":
        out = inc(p.metric, p.where, by).withColumnRenamed("increase", "value")
    elif p.kind == "share":
        out = m.increase_share(*kept(p.metric, p.where), by, all_match(p.num), p.window, p.step)
    elif p.kind == "over":
        gains = [m.increments(*kept(metric, where), p.step) for metric, where in ((p.metric, p.where), (p.other, other_where))]
        out = m.gain_ratio(*gains, by, p.window, p.step)
    elif p.kind in ("quantile", "quantile_agg"):
        out = m.histogram_quantile(p.q, m.bucket_increase(*kept(p.metric, p.where), by, p.window, p.step), by)
        if p.kind == "quantile_agg":
            out = m.aggregate(out.where(~F.isnan("value")), p.agg, [])
            by = []
    elif p.kind == "instant":
        out = vector(p.metric, p.where)
        by = ms.series_of(p.metric)
    elif p.kind == "instant_agg":
        got = vector(p.metric, p.where)
        out = m.aggregate(got.where(p.keep) if p.keep else got, p.agg, by)
    elif p.kind == "instant_over":
        out = m.vector_ratio(vector(p.metric, p.where), vector(p.other, other_where), by)
    elif p.kind == "minus":
        out = m.join_difference(
            m.aggregate(vector(p.metric, p.where), "avg", by), m.aggregate(vector(p.other, other_where), "avg", by), by
        )
    elif p.kind == "max_over_time":
        by = ms.series_of(p.metric)
        out = m.max_over_time(*kept(p.metric, p.where), p.window, p.step)
    else:
        raise ValueError(f"unknown panel kind {p.kind}")
    if p.keep and p.kind != "instant_agg":
        out = out.where(p.keep)
    if p.post:
        out = out.withColumn("value", F.expr(p.post))
    return out.select(*by, "eval_t", "value")


def run_panel(p: Panel):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evaluate(p, lambda metric: ms.samples(spark, sf_dir, metric))

    return build


def stream_parts(p: Panel) -> tuple[list[str], dict[str, Column | None]]:
    """The labels and the sums that a rule needs of each evaluation time."""
    if p.kind == "share":
        return list(p.by), {"_n": all_match(p.num), "_d": None}
    if p.kind in ("rate", "increase"):
        return list(p.by), {"increase": None}
    if p.kind == "quantile":
        return [*p.by, "le"], {"increase": None}
    if p.kind == "over":  # samples of both metrics in one stream, told apart by ``is_num``
        return list(p.by), {"_n": F.col("is_num"), "_d": ~F.col("is_num")}
    raise ValueError(f"no stream form of {p.kind}")


def finished(p: Panel, vector: DataFrame) -> DataFrame:
    """Rows (labels, eval_t, value) of a rule from the sums of :func:`stream_parts`."""
    by = list(p.by)
    if p.kind in ("share", "over"):
        known = vector.where("_n IS NOT NULL AND _d IS NOT NULL")
        out = known.select(*by, "eval_t", metric_div(F.col("_n"), F.col("_d")).alias("value"))
    elif p.kind == "rate":
        out = vector.select(*by, "eval_t", (F.col("increase") / p.window).alias("value"))
    elif p.kind == "increase":
        out = vector.select(*by, "eval_t", F.col("increase").alias("value"))
    else:
        out = m.histogram_quantile(p.q, vector, by)
    if p.keep:
        out = out.where(p.keep)
    if p.post:
        out = out.withColumn("value", F.expr(p.post))
    return out.select(*by, "eval_t", "value")


# ---- the same in SQL ---------------------------------------------------------------------------


def _cond(ws: tuple[Match, ...]) -> str:
    parts = []
    for w in ws:
        if w.op in ("=", "!="):
            parts.append(f"{w.label} {'=' if w.op == '=' else '<>'} '{w.value}'")
        else:
            parts.append(("" if w.op == "=~" else "NOT ") + f"regexp_full_match({w.label}, '{w.value}')")
    return " AND ".join(parts) or "TRUE"


def _ends(p: Panel, window: int) -> str:
    first = f"t // {p.step} * {p.step}"
    return f"unnest(range({first} + {p.step}, {first} + {window} + 1, {p.step})) AS eval_t"


def _inc_sql(p: Panel, metric: str, where: tuple[Match, ...]) -> str:
    labels = ", ".join(ms.series_of(metric))
    return (
        f"SELECT {labels}, eval_t, arg_max(cv, t) - arg_min(cv, t) AS increase FROM (SELECT {labels}, t, cv, {_ends(p, p.window)}"
        f" FROM (SELECT *, value + sum(d) OVER (PARTITION BY {labels} ORDER BY t) AS cv FROM (SELECT *, CASE WHEN value <"
        f" lag(value) OVER (PARTITION BY {labels} ORDER BY t) THEN lag(value) OVER (PARTITION BY {labels} ORDER BY t)"
        f" ELSE 0 END AS d FROM ({ms.samples_sql(metric)}) s WHERE {_cond(where)}) a) b) c"
        f" GROUP BY {labels}, eval_t HAVING count(*) >= 2"
    )


def _vector_sql(p: Panel, metric: str, where: tuple[Match, ...], window: int = 300, f: str = "arg_max(value, t)") -> str:
    labels = ", ".join(ms.series_of(metric))
    return (
        f"SELECT {labels}, eval_t, {f} AS value FROM (SELECT *, {_ends(p, window)} FROM ({ms.samples_sql(metric)}) s"
        f" WHERE {_cond(where)}) x GROUP BY {labels}, eval_t"
    )


def panel_sql(p: Panel) -> str:
    by = "".join(f"{b}, " for b in p.by)
    other_where = p.where if p.other_where is None else p.other_where

    def agg(body: str, how: str, names: str) -> str:
        f = {"avg": "sum(value) / count(value)", "count": "count(value)::DOUBLE"}.get(how, f"{how}(value)")
        return f"SELECT {names}eval_t, {f} AS value FROM ({body}) v GROUP BY {names}eval_t"

    def summed(metric: str, where: tuple[Match, ...], names: str) -> str:
        return f"SELECT {names}eval_t, sum(increase) AS value FROM ({_inc_sql(p, metric, where)}) i GROUP BY {names}eval_t"

    def over(left: str, right: str) -> str:
        on = " AND ".join(f"l.{c} = r.{c}" for c in (*p.by, "eval_t"))
        cols = "".join(f"l.{c}, " for c in p.by)
        return (
            f"SELECT {cols}l.eval_t, CASE WHEN r.value <> 0 THEN l.value / r.value WHEN l.value = 0 THEN 'nan'::DOUBLE"
            f" ELSE 'inf'::DOUBLE END AS value FROM ({left}) l JOIN ({right}) r ON {on}"
        )

    if p.kind == "rate":
        body = f"SELECT {by}eval_t, value / {p.window} AS value FROM ({summed(p.metric, p.where, by)}) x"
    elif p.kind == "rate_agg":
        body = agg(f"SELECT *, increase / {p.window} AS value FROM ({_inc_sql(p, p.metric, p.where)}) s", p.agg, by)
    elif p.kind == "increase":
        body = summed(p.metric, p.where, by)
    elif p.kind == "share":
        num = summed(p.metric, (*p.where, *p.num), by)
        body = over(num, summed(p.metric, p.where, by))
    elif p.kind == "over":
        body = over(summed(p.metric, p.where, by), summed(p.other, other_where, by))
    elif p.kind in ("quantile", "quantile_agg"):
        q = f"{p.q}::DOUBLE"
        part = f"PARTITION BY {by}eval_t"
        lower = "coalesce(pl, CASE WHEN le <= 0 THEN le ELSE 0 END)"
        body = (
            f"SELECT {by}eval_t, CASE WHEN max(total) > 0 THEN arg_min(val, le) ELSE 'nan'::DOUBLE END AS value FROM (SELECT {by}eval_t, le, total,"
            f" cc, CASE WHEN le = 'inf'::DOUBLE THEN pl WHEN cc = pc THEN le ELSE {lower} + (le - {lower}) * (({q} * total - pc) / (cc - pc))"
            f" END AS val FROM (SELECT *, max(cc) OVER ({part}) AS total, coalesce(lag(cc) OVER ({part} ORDER BY le), 0) AS pc,"
            f" lag(le) OVER ({part} ORDER BY le) AS pl FROM (SELECT *, max(value) OVER ({part} ORDER BY le) AS cc FROM"
            f" (SELECT * REPLACE (CASE le WHEN '+Inf' THEN 'inf'::DOUBLE ELSE le::DOUBLE END AS le) FROM"
            f" ({summed(p.metric, p.where, by + 'le, ')}) a0) a) b) c) d WHERE cc >= {q} * total GROUP BY {by}eval_t"
        )
        if p.kind == "quantile_agg":
            body = agg(f"SELECT * FROM ({body}) z WHERE NOT isnan(value)", p.agg, "")
    elif p.kind == "instant":
        body = _vector_sql(p, p.metric, p.where)
    elif p.kind == "instant_agg":
        got = _vector_sql(p, p.metric, p.where)
        body = agg(f"SELECT * FROM ({got}) g WHERE {p.keep or 'TRUE'}", p.agg, by)
    elif p.kind == "instant_over":
        body = over(
            agg(_vector_sql(p, p.metric, p.where), "sum", by), agg(_vector_sql(p, p.other, other_where), "sum", by)
        )
    elif p.kind == "minus":
        on = " AND ".join(f"l.{c} = r.{c}" for c in (*p.by, "eval_t"))
        left = agg(_vector_sql(p, p.metric, p.where), "avg", by)
        right = agg(_vector_sql(p, p.other, other_where), "avg", by)
        cols = "".join(f"l.{c}, " for c in p.by)
        body = f"SELECT {cols}l.eval_t, l.value - r.value AS value FROM ({left}) l JOIN ({right}) r ON {on}"
    elif p.kind == "max_over_time":
        body = _vector_sql(p, p.metric, p.where, p.window, "max(value)")
    else:
        raise ValueError(p.kind)
    if p.keep and p.kind != "instant_agg":
        body = f"SELECT * FROM ({body}) k WHERE {p.keep}"
    if p.post:
        body = f"SELECT * REPLACE ({p.post} AS value) FROM ({body}) k"
    return body


# ---- the panels --------------------------------------------------------------------------------

JOB = (eq("job", "vllm-models"),)
QUANT = (*JOB, re("app", "mistral-7b-awq|mistral-7b-fp16"))
FINETUNE = (*JOB, re("app", "mistral-7b-lora|mistral-7b-fp16"))
JUDGE = (*JOB, eq("app", "mistral-7b-judge"))
ALL = (*JOB, re("app", "mistral-7b-.*"))
W15 = dict(window=900, step=60)
H1 = dict(window=3600, step=300)
SERVERS = (re("app", "mistral-7b-.*"),)
BASELINE = (eq("namespace", "llm-baseline"),)
E2E, TTFT = "vllm:e2e_request_latency_seconds_bucket", "vllm:time_to_first_token_seconds_bucket"
TPOT = "vllm:time_per_output_token_seconds_bucket"
THROUGHPUT, CACHE = "vllm:avg_generation_throughput_toks_per_s", "vllm:gpu_cache_usage_perc"
WAITING, RUNNING = "vllm:num_requests_waiting", "vllm:num_requests_running"
SUCCESS, TOKENS = "vllm:request_success_total", "vllm:generation_tokens_total"
PERCENT = "value * 100"
IMAGE = (ne("image", ""),)
DISK = (eq("mountpoint", "/"), ne("fstype", "rootfs"))
DEVICE = (nre("device", "lo|veth.*|docker.*|br.*"),)
G5XX = (re("status", "5.."),)

RECORDING_RULES = [
    Panel("rule_http_request_rate", "rate", "http_server_request_count_total", ("service_name",), covers=("M3", "A9", "M8")),
    Panel("rule_http_error_ratio", "share", "http_server_request_count_total", ("service_name",), num=(re("http_status_code", "5.."),), covers=("P12", "J6")),
    Panel("rule_http_latency_p95", "quantile", "http_server_request_duration_seconds_bucket", ("service_name",), covers=("M5",)),
    Panel("rule_invoke_latency_p95", "quantile", "sagemaker_invoke_duration_seconds_bucket", ("endpoint",), covers=("M5",)),
    Panel("rule_invoke_error_rate", "rate", "sagemaker_invoke_errors_total", ("endpoint",), covers=("M3", "A9")),
    Panel("rule_gateway_requests_by_team", "rate", "gateway_requests_total", ("team",), covers=("M3", "A9")),
    Panel("rule_pod_restarts_increase", "increase", "kube_pod_container_status_restarts_total", ("namespace", "pod"), covers=("M2",)),
    Panel("rule_team_error_ratio", "share", "lab_service_requests_total", ("team",), num=(re("status_code", "5.."),)),
    Panel("rule_team_latency_p95", "quantile", "lab_llm_e2e_duration_ms_bucket", ("team",)),
    Panel("rule_variant_tokens_per_second", "over", "genai_usage_output_tokens_total", ("variant_id",), other="lab_llm_e2e_duration_ms_sum", post="value * 1000", covers=("M14", "M6")),
]

SCHEMA_PANELS = [
    Panel("schema_request_volume_by_team", "rate", "lab_gateway_requests_total", ("target_team",)),
    Panel("schema_error_rate_by_variant", "share", "lab_service_requests_total", ("variant_id",), num=(re("status_code", "5.."),)),
    Panel("schema_p95_by_variant_type", "quantile", "lab_llm_e2e_duration_ms_bucket", ("variant_type",)),
    Panel("schema_ab_bucket_distribution", "increase", "lab_gateway_requests_total", ("ab_bucket",), **H1),
    Panel("schema_token_throughput", "rate", "genai_usage_output_tokens_total", ("team",)),
]

HARNESS_PANELS = [
    Panel("harness_latency_p95_by_scenario", "quantile", "lab_harness_latency_ms_bucket", ("scenario_id",)),
    Panel("harness_error_rate_by_scenario", "over", "lab_harness_fail_total", ("scenario_id",), other="lab_harness_requests_total", covers=("J6",)),
    Panel("harness_platform_overhead", "minus", "lab_harness_last_latency_ms", ("team",), (eq("scenario_id", "perf_throughput"),), other="lab_llm_last_duration_ms", other_where=(), covers=("J7",)),
    Panel("harness_canary_pass_rate", "over", "lab_harness_pass_total", ("team", "variant"), (eq("scenario_id", "canary"),), other="lab_harness_requests_total"),
    Panel("harness_queue_depth_peak", "max_over_time", "lab_llm_inflight_requests", where=(eq("scenario_id", "perf_throughput"),), covers=("M4",)),
    Panel("rollout_pod_traffic", "rate", "lab_service_requests_total", ("kubernetes_pod_name",), window=60, covers=("T-b",)),
    Panel("rollout_504_rate", "rate", "lab_service_requests_total", ("team",), (eq("status_code", "504"),), window=60, step=30, covers=("T-b",)),
    Panel("rollout_long_bucket_p95", "quantile", "lab_llm_e2e_duration_ms_bucket", (), (eq("bucket", "long"),)),
    Panel("rollout_pending_pods", "instant", "kube_pod_status_phase", where=(eq("namespace", "quant"), eq("phase", "Pending")), covers=("M1",)),
    Panel("rollout_long_bucket_overhead", "minus", "lab_harness_last_latency_ms", (), (eq("bucket", "long"),), other="lab_llm_last_duration_ms", covers=("J7",)),
]

STATS_PANELS = [
    Panel("stats_latency_p50", "quantile", "gateway_latency_ms_bucket", q=0.5, covers=("A8", "M5")),
    Panel("stats_latency_p95", "quantile", "gateway_latency_ms_bucket", q=0.95, covers=("A8", "M5")),
    Panel("stats_latency_p99", "quantile", "gateway_latency_ms_bucket", q=0.99, covers=("A8", "M5")),
]

OVERVIEW_PANELS = [
    Panel("overview_active_models", "instant_agg", "up", (), JOB, step=60, agg="count", keep="value = 1", covers=("P13",)),
    Panel("overview_total_rps", "rate", SUCCESS, (), JOB, **W15),
    Panel("overview_worst_p95", "quantile_agg", E2E, ("app",), JOB, agg="max", **W15),
    Panel("overview_queue_depth", "instant_agg", WAITING, (), JOB, step=60),
    Panel("overview_throughput", "instant_agg", THROUGHPUT, (), JOB, step=60),
    Panel("overview_cache_avg", "instant_agg", CACHE, (), JOB, step=60, agg="avg", post=PERCENT, covers=("P14",)),
]


def model_row(prefix: str, where: tuple[Match, ...]) -> list[Panel]:
    return [
        Panel(f"{prefix}_latency_p95", "quantile", E2E, ("app",), where, **W15),
        Panel(f"{prefix}_throughput", "instant", THROUGHPUT, where=where, step=60, covers=("M1",)),
        Panel(f"{prefix}_ttft_p95", "quantile", TTFT, ("app",), where, **W15),
        Panel(f"{prefix}_cache", "instant", CACHE, where=where, step=60, post=PERCENT),
    ]


def harness_row(prefix: str, team: str) -> list[Panel]:
    where = (eq("team", team),)
    return [
        Panel(f"{prefix}_pass_rate", "over", "lab_harness_pass_total", (), where, other="lab_harness_requests_total", post=PERCENT, **H1),
        Panel(f"{prefix}_harness_latency", "over", "lab_harness_latency_ms_sum", (), where, other="lab_harness_latency_ms_count", covers=("M6",), **W15),
    ]


TEAM_PANELS = [
    *model_row("quant", QUANT),
    *harness_row("quant", "quant"),
    *model_row("finetune", FINETUNE),
    *harness_row("finetune", "finetune"),
    *model_row("judge", JUDGE),
    Panel("judge_requests_running", "instant", RUNNING, where=JUDGE, step=60),
    Panel("judge_requests_waiting", "instant", WAITING, where=JUDGE, step=60),
    harness_row("eval", "eval")[0],
    Panel("judge_tokens_per_request", "over", TOKENS, ("app",), JUDGE, other=SUCCESS, covers=("J6",), **W15),
]

HEAD_TO_HEAD = [
    *model_row("all_models", ALL),
    Panel("all_models_request_rate", "rate", SUCCESS, ("app",), ALL, covers=("M12",), **W15),
    Panel("all_models_running", "instant", RUNNING, where=ALL, step=60),
    Panel("all_models_waiting", "instant", WAITING, where=ALL, step=60, covers=("P12",)),
    Panel("all_models_decode_time_p95", "quantile", TPOT, ("app",), SERVERS),
    Panel("all_models_tokens_generated", "instant", TOKENS, where=SERVERS),
]

BENCHMARK_PANELS = [
    Panel("benchmark_requests", "increase", "lab_harness_requests_total", **H1),
    Panel("benchmark_pass_rate", "over", "lab_harness_pass_total", other="lab_harness_requests_total", post=PERCENT, **H1),
    Panel("benchmark_avg_latency", "over", "lab_harness_latency_ms_sum", other="lab_harness_latency_ms_count", **W15),
    Panel("benchmark_pass_rate_by_team", "over", "lab_harness_pass_total", ("team",), other="lab_harness_requests_total", post=PERCENT, **H1),
    Panel("benchmark_traffic_by_team", "increase", "lab_gateway_requests_total", ("team",), (re("team", "quant|finetune|eval"),), **H1),
    Panel("request_volume_by_team", "increase", "lab_gateway_requests_total", ("team",), **H1),
]

CLUSTER_PANELS = [
    Panel("cluster_nodes", "instant_agg", "kube_node_info", agg="count"),
    Panel("cluster_running_pods", "instant_agg", "kube_pod_status_phase", (), (eq("phase", "Running"),)),
    Panel("cluster_namespaces", "instant_agg", "kube_namespace_created", agg="count"),
    Panel("cluster_deployments", "instant_agg", "kube_deployment_created", agg="count"),
    Panel("cluster_restarts", "increase", "kube_pod_container_status_restarts_total", **H1),
    Panel("cluster_failed_pods", "instant_agg", "kube_pod_status_phase", (), (re("phase", "Failed|Unknown"),)),
    Panel("namespace_pods", "instant_agg", "kube_pod_status_phase", ("namespace",), (eq("phase", "Running"),)),
    Panel("namespace_restarts", "increase", "kube_pod_container_status_restarts_total", ("namespace",)),
    Panel("namespace_cpu", "rate", "container_cpu_usage_seconds_total", ("namespace",), IMAGE),
    Panel("namespace_memory", "instant_agg", "container_memory_working_set_bytes", ("namespace",), IMAGE),
    Panel("pod_status", "instant", "kube_pod_status_phase", step=60, keep="value = 1", covers=("P13",)),
    Panel("node_cpu", "rate_agg", "node_cpu_seconds_total", ("node",), (eq("mode", "idle"),), agg="avg", post="100 - value * 100", covers=("P14",)),
    Panel("node_memory", "instant_over", "node_memory_MemAvailable_bytes", ("instance",), other="node_memory_MemTotal_bytes", post="100 * (1 - value)", covers=("J6", "P14")),
    Panel("node_disk", "instant_over", "node_filesystem_avail_bytes", ("instance", "mountpoint", "fstype"), DISK, other="node_filesystem_size_bytes", post="100 - value * 100"),
    Panel("node_network_rx", "rate", "node_network_receive_bytes_total", ("instance", "device"), DEVICE, covers=("P12",)),
    Panel("node_network_tx", "rate", "node_network_transmit_bytes_total", ("instance", "device"), DEVICE, post="-value", covers=("P14",)),
    Panel("node_load", "instant", "node_load1"),
    Panel("node_info", "instant", "kube_node_info"),
    Panel("namespace_memory_quota", "instant_over", "container_memory_usage_bytes", ("namespace",), other="kube_resourcequota", other_where=(eq("resource", "limits.memory"),), covers=("J6",)),
    Panel("pod_readiness_ratio", "instant_over", "kube_pod_status_ready", ("namespace",), (eq("condition", "true"),), other="kube_pod_status_ready", other_where=(), covers=("J6",)),
]

OPERATIONS_PANELS = [
    Panel("platform_request_rate", "rate", "gateway_requests_total"),
    Panel("platform_error_rate", "share", "gateway_requests_total", num=G5XX),
    Panel("platform_team_requests", "increase", "gateway_requests_total", ("team",), **H1),
    Panel("platform_p95_by_team", "quantile", "gateway_latency_ms_bucket", ("team",)),
    Panel("operations_error_ratio_by_team", "share", "gateway_requests_total", ("team",), num=G5XX),
    Panel("invoke_timeouts_by_endpoint", "rate", "sagemaker_invoke_errors_total", ("endpoint",), (eq("error_type", "timeout"),)),
    Panel("pods_not_ready", "instant", "kube_pod_status_ready", where=(eq("condition", "false"),), step=60, keep="value = 1", covers=("M13",)),
    Panel("strip_active_models", "instant_agg", "up", (), SERVERS, agg="count", keep="value = 1"),
    Panel("strip_total_rps", "rate", SUCCESS, (), SERVERS),
    # Rounded: a mean of fractions depends on the order they are added in.
    Panel("strip_p95_mean_of_models", "quantile_agg", E2E, ("app",), SERVERS, agg="avg", post="round(value * 1000000000) / 1000000000"),
    Panel("strip_throughput_avg", "instant_agg", THROUGHPUT, (), SERVERS, agg="avg"),
    Panel("strip_waiting", "instant_agg", WAITING, (), SERVERS),
    Panel("strip_cache_avg", "instant_agg", CACHE, (), SERVERS, agg="avg", post=PERCENT),
    Panel("queue_average", "instant_agg", "vllm_num_requests_waiting", (), BASELINE, agg="avg", covers=("M13",)),
    Panel("model_queue_depth", "instant", "vllm_num_requests_waiting", where=BASELINE),
    Panel("model_request_rate", "rate", "vllm_request_success_total", where=BASELINE),
    Panel("model_latency_p95", "quantile", "vllm_e2e_request_latency_seconds_bucket", where=BASELINE),
    Panel("model_cache_pressure", "instant", "vllm_gpu_cache_usage_perc", where=BASELINE),
    Panel("model_ttft_p95", "quantile", "vllm_time_to_first_token_seconds_bucket", where=BASELINE),
    Panel("model_token_throughput", "rate", "vllm_request_generation_tokens_sum", where=BASELINE),
]

PANELS = [
    *RECORDING_RULES, *SCHEMA_PANELS, *HARNESS_PANELS, *STATS_PANELS, *OVERVIEW_PANELS, *TEAM_PANELS,
    *HEAD_TO_HEAD, *BENCHMARK_PANELS, *CLUSTER_PANELS, *OPERATIONS_PANELS,
]
