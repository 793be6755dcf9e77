"""Registers the panels and the queries built on evaluated vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions.labels import Match, matches, promote
from assayer.functions.numbers import ratio, scalar_or_default
from assayer.operators import metrics as m
from assayer.plans import metric_standins as ms
from assayer.plans import standins
from assayer.plans.dataset_queries import folder
from assayer.plans.panels import PANELS, RECORDING_RULES, Panel, panel_sql, run_panel
from assayer.plans.registry import add, query
from assayer.sources import signals

for panel in PANELS:
    add(panel.name, run_panel(panel), panel_sql(panel), ["requests"], panel.covers)


def _panel(name: str) -> Panel:
    return next(p for p in PANELS if p.name == name)


def _evaluated(name: str):
    return run_panel(_panel(name))


# ---- emission ----------------------------------------------------------------------------------


@query(
    "emitted_counter",
    f"SELECT * FROM ({ms.samples_sql('gateway_outcomes_total')}) s",
    ["requests"],
    ["M9", "W2", "T13"],
)
def emitted_counter(spark, sf_dir):
    return ms.samples(spark, sf_dir, "gateway_outcomes_total").select("team", "status", "t", "value")


@query(
    "emitted_histogram",
    f"SELECT * FROM ({ms.samples_sql('gateway_latency_ms_bucket')}) s",
    ["requests"],
    ["M10"],
)
def emitted_histogram(spark, sf_dir):
    return ms.samples(spark, sf_dir, "gateway_latency_ms_bucket").select("team", "le", "t", "value")


@query("metrics_from_signals", panel_sql(_panel("rule_gateway_requests_by_team")), ["requests"], ["S7", "P12", "M3"])
def metrics_from_signals(spark, sf_dir):
    """Samples stored with label maps, as a collector writes them, read back, promoted to columns and evaluated."""
    name, names = "gateway_requests_total", ["team", "status"]
    pairs = [x for n in names for x in (F.lit(n), F.col(n))]
    stored = ms.samples(spark, sf_dir, name).select(
        F.lit(name).alias("metric"), F.create_map(*pairs).alias("labels"), F.timestamp_seconds("t").alias("ts"), "value"
    )
    path = folder(spark, "signals")
    stored.write.parquet(path)
    back = signals.read_signals(spark, "metrics", path, stream=False).where(F.col("metric") == name)
    promoted = promote(back, names).withColumn("t", F.unix_seconds("ts"))
    return m.rate(promoted, names, ["team"], 300, 30)


@query(
    "harness_counters_with_errors",
    "SELECT team, scenario_id, answered AS requests, passed, total - passed AS failed, passed::DOUBLE / nullif(answered, 0) AS pass_of_answered,"
    " passed::DOUBLE / total AS pass_of_all FROM (SELECT team, scenario_id, count(*) AS total, count(*) FILTER (status <> 'timeout') AS answered,"
    " count(*) FILTER (status = 'success') AS passed FROM requests GROUP BY ALL) x",
    ["requests"],
    ["T7"],
)
def harness_counters_with_errors(spark, sf_dir):
    # A transport error counts as failed but not as a request, so two denominators are reported.
    def n(cond):
        return F.count(F.when(cond, 1))

    status = F.col("status")
    sums = standins.requests(spark, sf_dir).groupBy("team", "scenario_id").agg(
        n(status != "timeout").alias("requests"), n(status == "success").alias("passed"), F.count(F.lit(1)).alias("_total")
    )
    return sums.select(
        "team",
        "scenario_id",
        "requests",
        "passed",
        (F.col("_total") - F.col("passed")).alias("failed"),
        ratio(F.col("passed"), F.col("requests")).alias("pass_of_answered"),
        ratio(F.col("passed"), F.col("_total")).alias("pass_of_all"),
    )


@query(
    "in_flight_requests",
    "WITH m AS (SELECT team, us, sum(d) AS d FROM (SELECT team, us, 1 AS d FROM requests UNION ALL SELECT team, us + latency_ms * 1000, -1 FROM requests) x"
    " GROUP BY team, us), l AS (SELECT team, us // 60000000 * 60 AS t, us, sum(d) OVER (PARTITION BY team ORDER BY us) AS level FROM m)"
    " SELECT team, t, CAST(arg_max(level, us) AS BIGINT) AS level, CAST(max(level) AS BIGINT) AS peak FROM l GROUP BY team, t",
    ["requests"],
    ["M11", "W2"],
)
def in_flight_requests(spark, sf_dir):
    r = standins.requests(spark, sf_dir).select("team", "us", F.expr("us + latency_ms * 1000").alias("end_us"))
    return m.in_flight(r, ["team"], "us", "end_us", 60)


# ---- read off evaluated vectors ------------------------------------------------------------------


@query(
    "latency_levels",
    f"SELECT app, eval_t, CASE WHEN value >= 5 THEN 'red' WHEN value >= 2 THEN 'yellow' ELSE 'green' END AS level FROM ({panel_sql(_panel('all_models_latency_p95'))}) p",
    ["requests"],
    ["P16"],
)
def latency_levels(spark, sf_dir):
    out = _evaluated("all_models_latency_p95")(spark, sf_dir)
    steps = [(None, "green"), (2, "yellow"), (5, "red")]
    return out.select("app", "eval_t", m.threshold_level(F.col("value"), steps).alias("level"))


@query(
    "latest_queue_depth",
    f"SELECT app, namespace, arg_max(value, eval_t) AS value, max(eval_t) AS eval_t FROM ({panel_sql(_panel('model_queue_depth'))}) p GROUP BY app, namespace",
    ["requests"],
    ["P17"],
)
def latest_queue_depth(spark, sf_dir):
    return m.last_non_null(_evaluated("model_queue_depth")(spark, sf_dir), ["app", "namespace"])


@query(
    "queue_breaches",
    f"WITH v AS (SELECT eval_t, value FROM ({panel_sql(_panel('queue_average'))}) p WHERE value > 5), g AS (SELECT *, eval_t - 30 * row_number()"
    " OVER (ORDER BY eval_t) AS grp FROM v) SELECT min(eval_t) AS started_at, max(eval_t) AS ended_at, count(*) AS steps, max(value) AS peak FROM g GROUP BY grp",
    ["requests"],
    ["M13"],
)
def queue_breaches(spark, sf_dir):
    return m.breach_episodes(_evaluated("queue_average")(spark, sf_dir), [], F.col("value") > 5, 30)


@query(
    "restart_alerts",
    f"WITH v AS (SELECT * FROM ({panel_sql(_panel('rule_pod_restarts_increase'))}) p WHERE value > 0), g AS (SELECT *, eval_t - 30 * row_number()"
    " OVER (PARTITION BY namespace, pod ORDER BY eval_t) AS grp FROM v)"
    " SELECT namespace, pod, min(eval_t) AS started_at, max(eval_t) AS ended_at, count(*) AS steps, max(value) AS peak FROM g GROUP BY namespace, pod, grp",
    ["requests"],
    ["M13"],
)
def restart_alerts(spark, sf_dir):
    return m.breach_episodes(_evaluated("rule_pod_restarts_increase")(spark, sf_dir), ["namespace", "pod"], F.col("value") > 0, 30)


@query(
    "safe_error_ratio",
    "WITH f AS (" + panel_sql(Panel("f", "increase", "lab_harness_fail_total", ("team",))) + "), p AS ("
    + panel_sql(Panel("p", "increase", "lab_harness_pass_total", ("team",)))
    + ") SELECT f.team, f.eval_t, CASE WHEN p.value <> 0 THEN f.value / p.value ELSE 0.0::DOUBLE END AS value FROM f JOIN p ON p.team = f.team AND p.eval_t = f.eval_t",
    ["requests"],
    ["P15", "P14"],
)
def safe_error_ratio(spark, sf_dir):
    # Failures per pass: 0/0 and x/0 occur, and both become 0 in the service statistics.
    p = Panel("failures_per_pass", "over", "lab_harness_fail_total", ("team",), other="lab_harness_pass_total")
    out = run_panel(p)(spark, sf_dir)
    return out.withColumn("value", scalar_or_default(F.col("value")))


DEPLOYMENT = {
    "desired": "kube_deployment_spec_replicas",
    "available": "kube_deployment_status_replicas_available",
    "unavailable": "kube_deployment_status_replicas_unavailable",
}


@query(
    "deployment_replicas",
    "SELECT namespace, deployment, eval_t, " + ", ".join(f"max(value) FILTER (c = '{c}') AS {c}" for c in DEPLOYMENT) + " FROM ("
    + " UNION ALL ".join(
        f"SELECT *, '{c}' AS c FROM ({panel_sql(Panel(c, 'instant', metric))}) p_{c}" for c, metric in DEPLOYMENT.items()
    )
    + ") x GROUP BY namespace, deployment, eval_t",
    ["requests"],
    ["J13"],
)
def deployment_replicas(spark, sf_dir):
    parts = [
        run_panel(Panel(c, "instant", metric))(spark, sf_dir).withColumn("c", F.lit(c)) for c, metric in DEPLOYMENT.items()
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("namespace", "deployment", "eval_t").pivot("c", list(DEPLOYMENT)).agg(F.max("value"))


@query(
    "matched_series",
    "SELECT device, device = 'eth0' AS eq, device <> 'eth0' AS ne, regexp_full_match(device, 'lo|veth') AS re, NOT regexp_full_match(device, 'lo|veth.*') AS nre,"
    f" count(*) AS samples FROM ({ms.samples_sql('node_network_receive_bytes_total')}) s GROUP BY ALL",
    ["requests"],
    ["P12"],
)
def matched_series(spark, sf_dir):
    s = ms.samples(spark, sf_dir, "node_network_receive_bytes_total")
    checks = {"eq": Match("device", "=", "eth0"), "ne": Match("device", "!=", "eth0"), "re": Match("device", "=~", "lo|veth"), "nre": Match("device", "!~", "lo|veth.*")}
    return s.groupBy("device", *[matches(x).alias(name) for name, x in checks.items()]).agg(F.count(F.lit(1)).alias("samples"))


def _extrapolated_sql() -> str:
    w, step = 300, 30
    return (
        f"WITH e AS (SELECT *, unnest(range(t // {step} * {step} + {step}, t // {step} * {step} + {w} + 1, {step})) AS eval_t FROM"
        " (SELECT *, value + sum(d) OVER (PARTITION BY team, status ORDER BY t) AS cv FROM (SELECT *, CASE WHEN value < lag(value) OVER o THEN lag(value) OVER o ELSE 0 END AS d"
        f" FROM ({ms.samples_sql('gateway_requests_total')}) s WINDOW o AS (PARTITION BY team, status ORDER BY t)) a) b),"
        " g AS (SELECT team, status, eval_t, arg_max(cv, t) - arg_min(cv, t) AS inc, arg_min(value, t) AS raw, min(t) AS t0, max(t) AS t1, count(*) AS n FROM e"
        f" GROUP BY ALL HAVING count(*) >= 2), h AS (SELECT *, (t1 - t0)::DOUBLE AS span, (t1 - t0)::DOUBLE / (n - 1) AS gap, (eval_t - t1)::DOUBLE AS te,"
        f" least((t0 - (eval_t - {w}))::DOUBLE, CASE WHEN inc > 0 THEN (t1 - t0)::DOUBLE * raw / inc ELSE (t0 - (eval_t - {w}))::DOUBLE END) AS ts FROM g)"
        " SELECT team, status, eval_t, inc * ((span + CASE WHEN ts < gap * 1.1::DOUBLE THEN ts ELSE gap / 2 END + CASE WHEN te < gap * 1.1::DOUBLE THEN te ELSE gap / 2 END) / span) AS increase FROM h"
    )


@query("extrapolated_increase", _extrapolated_sql(), ["requests"], ["M2"])
def extrapolated_increase(spark, sf_dir):
    s = ms.samples(spark, sf_dir, "gateway_requests_total")
    return m.extrapolated_increase(s, ["team", "status"], 300, 30)


@query(
    "recording_rules",
    " UNION ALL ".join(
        f"SELECT '{p.name}' AS rule, {' || chr(44) || '.join(p.by)} AS labels, eval_t, value FROM ({panel_sql(p)}) r{i}"
        for i, p in enumerate(RECORDING_RULES)
    ),
    ["requests"],
    ["M8", "M7"],
)
def recording_rules(spark, sf_dir):
    """Rules under their names in one table, as a scheduled job would store them."""
    parts = [
        run_panel(p)(spark, sf_dir).select(F.lit(p.name).alias("rule"), F.concat_ws(",", *p.by).alias("labels"), "eval_t", "value")
        for p in RECORDING_RULES
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
