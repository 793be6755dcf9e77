"""Windows, steps, grouping, matchers and aggregation of rules and panels against the expressions they stand for.

The registered SQL is made from the same records as the plans; this table is not. A rule evaluates every 30 seconds.
"""

from __future__ import annotations

import pytest

from assayer.plans.panels import PANELS, RECORDING_RULES, Panel


def selector(metric, where, window=None):
    inside = ",".join(f'{m.label}{m.op}"{m.value}"' for m in where)
    return metric + (f"{{{inside}}}" if inside else "") + (f"[{window}s]" if window else "")


def spelled(p: Panel) -> str:
    """A panel as an expression; a vector's division matches on the labels it is grouped by."""
    by = f" by ({','.join(p.by)})" if p.by else ""
    other_where = p.where if p.other_where is None else p.other_where
    rate = lambda m, w: f"rate({selector(m, w, p.window)})"
    body = {
        "rate": lambda: f"sum{by}({rate(p.metric, p.where)})",
        "rate_agg": lambda: f"{p.agg}{by}({rate(p.metric, p.where)})",
        "increase": lambda: f"sum{by}(increase({selector(p.metric, p.where, p.window)}))",
        "share": lambda: f"sum{by}({rate(p.metric, (*p.where, *p.num))})/sum{by}({rate(p.metric, p.where)})",
        "over": lambda: f"sum{by}({rate(p.metric, p.where)})/sum{by}({rate(p.other, other_where)})",
        "quantile": lambda: f"quantile({p.q}, sum by ({','.join((*p.by, 'le'))})({rate(p.metric, p.where)}))",
        "quantile_agg": lambda: f"{p.agg}(quantile({p.q}, sum by ({','.join((*p.by, 'le'))})({rate(p.metric, p.where)})))",
        "instant": lambda: selector(p.metric, p.where),
        "instant_agg": lambda: f"{p.agg}{by}({selector(p.metric, p.where)})",
        "instant_over": lambda: f"sum{by}({selector(p.metric, p.where)})/sum{by}({selector(p.other, other_where)})",
        "minus": lambda: f"avg{by}({selector(p.metric, p.where)})-avg{by}({selector(p.other, other_where)})",
        "max_over_time": lambda: f"max_over_time({selector(p.metric, p.where, p.window)})",
    }[p.kind]()
    return body + (f" if {p.keep}" if p.keep else "") + (f" -> {p.post}" if p.post else "")


# The published rules and dashboard expressions, windows in seconds.
EXPECTED = {
    "rule_http_request_rate": "sum by (service_name)(rate(http_server_request_count_total[300s]))",
    "rule_http_error_ratio": 'sum by (service_name)(rate(http_server_request_count_total{http_status_code=~"5.."}[300s]))/sum by (service_name)(rate(http_server_request_count_total[300s]))',
    "rule_http_latency_p95": "quantile(0.95, sum by (service_name,le)(rate(http_server_request_duration_seconds_bucket[300s])))",
    "rule_invoke_latency_p95": "quantile(0.95, sum by (endpoint,le)(rate(sagemaker_invoke_duration_seconds_bucket[300s])))",
    "rule_invoke_error_rate": "sum by (endpoint)(rate(sagemaker_invoke_errors_total[300s]))",
    "rule_gateway_requests_by_team": "sum by (team)(rate(gateway_requests_total[300s]))",
    "rule_pod_restarts_increase": "sum by (namespace,pod)(increase(kube_pod_container_status_restarts_total[300s]))",
    "rule_team_error_ratio": 'sum by (team)(rate(lab_service_requests_total{status_code=~"5.."}[300s]))/sum by (team)(rate(lab_service_requests_total[300s]))',
    "rule_team_latency_p95": "quantile(0.95, sum by (team,le)(rate(lab_llm_e2e_duration_ms_bucket[300s])))",
    "rule_variant_tokens_per_second": "sum by (variant_id)(rate(genai_usage_output_tokens_total[300s]))/sum by (variant_id)(rate(lab_llm_e2e_duration_ms_sum[300s])) -> value * 1000",
    "harness_latency_p95_by_scenario": "quantile(0.95, sum by (scenario_id,le)(rate(lab_harness_latency_ms_bucket[300s])))",
    "harness_error_rate_by_scenario": "sum by (scenario_id)(rate(lab_harness_fail_total[300s]))/sum by (scenario_id)(rate(lab_harness_requests_total[300s]))",
    "harness_canary_pass_rate": 'sum by (team,variant)(rate(lab_harness_pass_total{scenario_id="canary"}[300s]))/sum by (team,variant)(rate(lab_harness_requests_total{scenario_id="canary"}[300s]))',
    "rollout_pod_traffic": "sum by (kubernetes_pod_name)(rate(lab_service_requests_total[60s]))",
    "rollout_504_rate": 'sum by (team)(rate(lab_service_requests_total{status_code="504"}[60s]))',
    "rollout_long_bucket_p95": 'quantile(0.95, sum by (le)(rate(lab_llm_e2e_duration_ms_bucket{bucket="long"}[300s])))',
    "cluster_nodes": "count(kube_node_info)",
    "cluster_running_pods": 'sum(kube_pod_status_phase{phase="Running"})',
    "cluster_namespaces": "count(kube_namespace_created)",
    "cluster_deployments": "count(kube_deployment_created)",
    "cluster_restarts": "sum(increase(kube_pod_container_status_restarts_total[3600s]))",
    "cluster_failed_pods": 'sum(kube_pod_status_phase{phase=~"Failed|Unknown"})',
    "namespace_pods": 'sum by (namespace)(kube_pod_status_phase{phase="Running"})',
    "namespace_restarts": "sum by (namespace)(increase(kube_pod_container_status_restarts_total[300s]))",
    "namespace_cpu": 'sum by (namespace)(rate(container_cpu_usage_seconds_total{image!=""}[300s]))',
    "namespace_memory": 'sum by (namespace)(container_memory_working_set_bytes{image!=""})',
    "pod_status": "kube_pod_status_phase if value = 1",
    "node_cpu": 'avg by (node)(rate(node_cpu_seconds_total{mode="idle"}[300s])) -> 100 - value * 100',
    "node_memory": "sum by (instance)(node_memory_MemAvailable_bytes)/sum by (instance)(node_memory_MemTotal_bytes) -> 100 * (1 - value)",
    "node_disk": 'sum by (instance,mountpoint,fstype)(node_filesystem_avail_bytes{mountpoint="/",fstype!="rootfs"})/sum by (instance,mountpoint,fstype)(node_filesystem_size_bytes{mountpoint="/",fstype!="rootfs"}) -> 100 - value * 100',
    "node_network_rx": 'sum by (instance,device)(rate(node_network_receive_bytes_total{device!~"lo|veth.*|docker.*|br.*"}[300s]))',
    "node_network_tx": 'sum by (instance,device)(rate(node_network_transmit_bytes_total{device!~"lo|veth.*|docker.*|br.*"}[300s])) -> -value',
    "node_load": "node_load1",
    "node_info": "kube_node_info",
    "schema_request_volume_by_team": "sum by (target_team)(rate(lab_gateway_requests_total[300s]))",
    "schema_error_rate_by_variant": 'sum by (variant_id)(rate(lab_service_requests_total{status_code=~"5.."}[300s]))/sum by (variant_id)(rate(lab_service_requests_total[300s]))',
    "schema_p95_by_variant_type": "quantile(0.95, sum by (variant_type,le)(rate(lab_llm_e2e_duration_ms_bucket[300s])))",
    "schema_ab_bucket_distribution": "sum by (ab_bucket)(increase(lab_gateway_requests_total[3600s]))",
    "schema_token_throughput": "sum by (team)(rate(genai_usage_output_tokens_total[300s]))",
    # Published as averages of histograms' names; the last measured latency stands for them.
    "harness_platform_overhead": 'avg by (team)(lab_harness_last_latency_ms{scenario_id="perf_throughput"})-avg by (team)(lab_llm_last_duration_ms)',
    "rollout_long_bucket_overhead": 'avg(lab_harness_last_latency_ms{bucket="long"})-avg(lab_llm_last_duration_ms{bucket="long"})',
    "harness_queue_depth_peak": 'max_over_time(lab_llm_inflight_requests{scenario_id="perf_throughput"}[300s])',
    "rollout_pending_pods": 'kube_pod_status_phase{namespace="quant",phase="Pending"}',
    "stats_latency_p50": "quantile(0.5, sum by (le)(rate(gateway_latency_ms_bucket[300s])))",
    "stats_latency_p95": "quantile(0.95, sum by (le)(rate(gateway_latency_ms_bucket[300s])))",
    "stats_latency_p99": "quantile(0.99, sum by (le)(rate(gateway_latency_ms_bucket[300s])))",
    "overview_active_models": 'count(up{job="vllm-models"}) if value = 1',
    "overview_total_rps": 'sum(rate(vllm:request_success_total{job="vllm-models"}[900s]))',
    "overview_worst_p95": 'max(quantile(0.95, sum by (app,le)(rate(vllm:e2e_request_latency_seconds_bucket{job="vllm-models"}[900s]))))',
    "overview_queue_depth": 'sum(vllm:num_requests_waiting{job="vllm-models"})',
    "overview_throughput": 'sum(vllm:avg_generation_throughput_toks_per_s{job="vllm-models"})',
    "overview_cache_avg": 'avg(vllm:gpu_cache_usage_perc{job="vllm-models"}) -> value * 100',
    "quant_latency_p95": 'quantile(0.95, sum by (app,le)(rate(vllm:e2e_request_latency_seconds_bucket{job="vllm-models",app=~"mistral-7b-awq|mistral-7b-fp16"}[900s])))',
    "quant_throughput": 'vllm:avg_generation_throughput_toks_per_s{job="vllm-models",app=~"mistral-7b-awq|mistral-7b-fp16"}',
    "quant_ttft_p95": 'quantile(0.95, sum by (app,le)(rate(vllm:time_to_first_token_seconds_bucket{job="vllm-models",app=~"mistral-7b-awq|mistral-7b-fp16"}[900s])))',
    "quant_cache": 'vllm:gpu_cache_usage_perc{job="vllm-models",app=~"mistral-7b-awq|mistral-7b-fp16"} -> value * 100',
    "quant_pass_rate": 'sum(rate(lab_harness_pass_total{team="quant"}[3600s]))/sum(rate(lab_harness_requests_total{team="quant"}[3600s])) -> value * 100',
    "quant_harness_latency": 'sum(rate(lab_harness_latency_ms_sum{team="quant"}[900s]))/sum(rate(lab_harness_latency_ms_count{team="quant"}[900s]))',
    "finetune_latency_p95": 'quantile(0.95, sum by (app,le)(rate(vllm:e2e_request_latency_seconds_bucket{job="vllm-models",app=~"mistral-7b-lora|mistral-7b-fp16"}[900s])))',
    "finetune_throughput": 'vllm:avg_generation_throughput_toks_per_s{job="vllm-models",app=~"mistral-7b-lora|mistral-7b-fp16"}',
    "finetune_ttft_p95": 'quantile(0.95, sum by (app,le)(rate(vllm:time_to_first_token_seconds_bucket{job="vllm-models",app=~"mistral-7b-lora|mistral-7b-fp16"}[900s])))',
    "finetune_cache": 'vllm:gpu_cache_usage_perc{job="vllm-models",app=~"mistral-7b-lora|mistral-7b-fp16"} -> value * 100',
    "finetune_pass_rate": 'sum(rate(lab_harness_pass_total{team="finetune"}[3600s]))/sum(rate(lab_harness_requests_total{team="finetune"}[3600s])) -> value * 100',
    "finetune_harness_latency": 'sum(rate(lab_harness_latency_ms_sum{team="finetune"}[900s]))/sum(rate(lab_harness_latency_ms_count{team="finetune"}[900s]))',
    "judge_latency_p95": 'quantile(0.95, sum by (app,le)(rate(vllm:e2e_request_latency_seconds_bucket{job="vllm-models",app="mistral-7b-judge"}[900s])))',
    "judge_throughput": 'vllm:avg_generation_throughput_toks_per_s{job="vllm-models",app="mistral-7b-judge"}',
    "judge_ttft_p95": 'quantile(0.95, sum by (app,le)(rate(vllm:time_to_first_token_seconds_bucket{job="vllm-models",app="mistral-7b-judge"}[900s])))',
    "judge_cache": 'vllm:gpu_cache_usage_perc{job="vllm-models",app="mistral-7b-judge"} -> value * 100',
    "judge_requests_running": 'vllm:num_requests_running{job="vllm-models",app="mistral-7b-judge"}',
    "judge_requests_waiting": 'vllm:num_requests_waiting{job="vllm-models",app="mistral-7b-judge"}',
    "judge_tokens_per_request": 'sum by (app)(rate(vllm:generation_tokens_total{job="vllm-models",app="mistral-7b-judge"}[900s]))/sum by (app)(rate(vllm:request_success_total{job="vllm-models",app="mistral-7b-judge"}[900s]))',
    "eval_pass_rate": 'sum(rate(lab_harness_pass_total{team="eval"}[3600s]))/sum(rate(lab_harness_requests_total{team="eval"}[3600s])) -> value * 100',
    "all_models_latency_p95": 'quantile(0.95, sum by (app,le)(rate(vllm:e2e_request_latency_seconds_bucket{job="vllm-models",app=~"mistral-7b-.*"}[900s])))',
    "all_models_throughput": 'vllm:avg_generation_throughput_toks_per_s{job="vllm-models",app=~"mistral-7b-.*"}',
    "all_models_ttft_p95": 'quantile(0.95, sum by (app,le)(rate(vllm:time_to_first_token_seconds_bucket{job="vllm-models",app=~"mistral-7b-.*"}[900s])))',
    "all_models_cache": 'vllm:gpu_cache_usage_perc{job="vllm-models",app=~"mistral-7b-.*"} -> value * 100',
    "all_models_request_rate": 'sum by (app)(rate(vllm:request_success_total{job="vllm-models",app=~"mistral-7b-.*"}[900s]))',
    "all_models_running": 'vllm:num_requests_running{job="vllm-models",app=~"mistral-7b-.*"}',
    "all_models_waiting": 'vllm:num_requests_waiting{job="vllm-models",app=~"mistral-7b-.*"}',
    "all_models_decode_time_p95": 'quantile(0.95, sum by (app,le)(rate(vllm:time_per_output_token_seconds_bucket{app=~"mistral-7b-.*"}[300s])))',
    "all_models_tokens_generated": 'vllm:generation_tokens_total{app=~"mistral-7b-.*"}',
    "benchmark_requests": "sum(increase(lab_harness_requests_total[3600s]))",
    "benchmark_pass_rate": "sum(rate(lab_harness_pass_total[3600s]))/sum(rate(lab_harness_requests_total[3600s])) -> value * 100",
    "benchmark_avg_latency": "sum(rate(lab_harness_latency_ms_sum[900s]))/sum(rate(lab_harness_latency_ms_count[900s]))",
    "benchmark_pass_rate_by_team": "sum by (team)(rate(lab_harness_pass_total[3600s]))/sum by (team)(rate(lab_harness_requests_total[3600s])) -> value * 100",
    "benchmark_traffic_by_team": 'sum by (team)(increase(lab_gateway_requests_total{team=~"quant|finetune|eval"}[3600s]))',
    "request_volume_by_team": "sum by (team)(increase(lab_gateway_requests_total[3600s]))",
    "namespace_memory_quota": 'sum by (namespace)(container_memory_usage_bytes)/sum by (namespace)(kube_resourcequota{resource="limits.memory"})',
    "pod_readiness_ratio": 'sum by (namespace)(kube_pod_status_ready{condition="true"})/sum by (namespace)(kube_pod_status_ready)',
    "platform_request_rate": "sum(rate(gateway_requests_total[300s]))",
    "platform_error_rate": 'sum(rate(gateway_requests_total{status=~"5.."}[300s]))/sum(rate(gateway_requests_total[300s]))',
    "platform_team_requests": "sum by (team)(increase(gateway_requests_total[3600s]))",
    "platform_p95_by_team": "quantile(0.95, sum by (team,le)(rate(gateway_latency_ms_bucket[300s])))",
    "operations_error_ratio_by_team": 'sum by (team)(rate(gateway_requests_total{status=~"5.."}[300s]))/sum by (team)(rate(gateway_requests_total[300s]))',
    "invoke_timeouts_by_endpoint": 'sum by (endpoint)(rate(sagemaker_invoke_errors_total{error_type="timeout"}[300s]))',
    "pods_not_ready": 'kube_pod_status_ready{condition="false"} if value = 1',
    "strip_active_models": 'count(up{app=~"mistral-7b-.*"}) if value = 1',
    "strip_total_rps": 'sum(rate(vllm:request_success_total{app=~"mistral-7b-.*"}[300s]))',
    "strip_p95_mean_of_models": 'avg(quantile(0.95, sum by (app,le)(rate(vllm:e2e_request_latency_seconds_bucket{app=~"mistral-7b-.*"}[300s])))) -> round(value * 1000000000) / 1000000000',
    "strip_throughput_avg": 'avg(vllm:avg_generation_throughput_toks_per_s{app=~"mistral-7b-.*"})',
    "strip_waiting": 'sum(vllm:num_requests_waiting{app=~"mistral-7b-.*"})',
    "strip_cache_avg": 'avg(vllm:gpu_cache_usage_perc{app=~"mistral-7b-.*"}) -> value * 100',
    "queue_average": 'avg(vllm_num_requests_waiting{namespace="llm-baseline"})',
    "model_queue_depth": 'vllm_num_requests_waiting{namespace="llm-baseline"}',
    "model_request_rate": 'sum(rate(vllm_request_success_total{namespace="llm-baseline"}[300s]))',
    "model_latency_p95": 'quantile(0.95, sum by (le)(rate(vllm_e2e_request_latency_seconds_bucket{namespace="llm-baseline"}[300s])))',
    "model_cache_pressure": 'vllm_gpu_cache_usage_perc{namespace="llm-baseline"}',
    "model_ttft_p95": 'quantile(0.95, sum by (le)(rate(vllm_time_to_first_token_seconds_bucket{namespace="llm-baseline"}[300s])))',
    "model_token_throughput": 'sum(rate(vllm_request_generation_tokens_sum{namespace="llm-baseline"}[300s]))',
}


def test_every_panel_has_its_expression():
    assert {p.name for p in PANELS} == set(EXPECTED) and len(PANELS) == len(EXPECTED)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_panel_says_what_its_expression_says(name):
    assert spelled(next(p for p in PANELS if p.name == name)) == EXPECTED[name]


def test_rules_are_evaluated_every_thirty_seconds():
    assert {p.step for p in RECORDING_RULES} == {30} and {p.name for p in RECORDING_RULES} <= set(EXPECTED)


def test_node_cpu_averages_idle_cores(spark):
    from assayer.operators import metrics as m

    rows = [("n", str(cpu), t, 0.9 * t) for cpu in range(4) for t in range(0, 601, 15)]
    samples = spark.createDataFrame(rows, "node string, cpu string, t bigint, value double")
    series = ["node", "cpu"]
    idle = m.aggregate(m.rate(samples, series, series, 300, 30), "avg", ["node"])
    used = 100 - idle.where("eval_t = 600").first().value * 100
    assert abs(used - 14.5) < 1e-9  # last minus first sample of the window [300, 600): 285 of 300 seconds


SPACED_PANELS = ["queue_average", "model_queue_depth", "model_request_rate", "model_latency_p95", "model_cache_pressure", "model_ttft_p95", "model_token_throughput"]


@pytest.mark.parametrize("name", SPACED_PANELS)
def test_model_panels_by_namespace_leave_out_no_server(spark, name):
    from assayer.functions.labels import all_match
    from assayer.plans import metric_standins as ms

    panel, folder = next(p for p in PANELS if p.name == name), "/root/testdata/sf0.001"
    samples = ms.samples(spark, folder, panel.metric)
    assert samples.where(all_match(panel.where)).count() == samples.count() > 0
