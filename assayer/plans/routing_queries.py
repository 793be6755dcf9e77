"""Queries on routing, request outcomes and service health."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import compare, routing
from assayer.plans import sqltext as q
from assayer.plans import standins as v
from assayer.plans.registry import query

# The sample route table.
ROUTE_TABLE = """{
 "quant": {"url": "http://quant-api:8000", "timeout_ms": 30000},
 "finetune": {"url": "http://finetune-api:8000", "timeout_ms": 60000,
              "ab_variants": {"lora-v1": {"weight": 80}, "lora-v2": {"weight": 20}}},
 "eval": {"url": "http://eval-api:8000", "timeout_ms": 45000}}"""

ROUTES_SQL = (
    "routes AS (SELECT * FROM (VALUES ('quant', 'http://quant-api:8000', 30000),"
    " ('finetune', 'http://finetune-api:8000', 60000),"
    " ('eval', 'http://eval-api:8000', 45000)) r(team, url, timeout_ms))"
)
# One in ten or so of the requests names a team nobody routes.
ASKED = "CASE WHEN k % 10 = 3 THEN 'vision' ELSE team END"
VARIANT = f"CASE WHEN team = 'finetune' THEN CASE WHEN {q.hash32('CAST(request_id AS VARCHAR)')} % 100 + 1 <= 80 THEN 'lora-v1' ELSE 'lora-v2' END END"


def asked(spark, sf_dir):
    return v.requests(spark, sf_dir).withColumn("team", F.expr(ASKED))


@query(
    "route_lookup",
    f"WITH {ROUTES_SQL}, a AS (SELECT request_id, {ASKED} AS team FROM requests)"
    " SELECT request_id, a.team, url, CAST(timeout_ms AS BIGINT) AS timeout_ms, CASE WHEN url IS NULL THEN 404 ELSE 200 END AS route_status"
    " FROM a LEFT JOIN routes r ON r.team = a.team",
    ["requests"],
    ["J4"],
)
def route_lookup(spark, sf_dir):
    got = routing.route_lookup(asked(spark, sf_dir), routing.read_routes(spark, ROUTE_TABLE))
    return got.select("request_id", "team", "url", "timeout_ms", "route_status")


@query(
    "denied_requests",
    f"SELECT team, count(*) AS denied FROM (SELECT {ASKED} AS team FROM requests) a WHERE team NOT IN ('quant', 'finetune', 'eval') GROUP BY team",
    ["requests"],
    ["J4"],
)
def denied_requests(spark, sf_dir):
    d = routing.denied(asked(spark, sf_dir), routing.read_routes(spark, ROUTE_TABLE))
    return d.groupBy("team").agg(F.count(F.lit(1)).alias("denied"))


def routed(spark, sf_dir):
    return routing.select_variant(
        v.requests(spark, sf_dir), routing.read_routes(spark, ROUTE_TABLE), F.col("request_id").cast("string")
    )


@query(
    "route_attributes",
    f"SELECT request_id, team || '-api' AS target_service, 'sagemaker:' || team || '-endpoint' AS target_endpoint,"
    " CASE WHEN bucket IS NULL THEN 'explicit_path' ELSE 'ab_bucket' END AS reason,"
    " CASE team WHEN 'quant' THEN 'quantized' WHEN 'finetune' THEN 'finetuned' ELSE 'evaluator' END AS model_intent,"
    f" bucket IS NOT NULL AS ab_enabled, bucket AS ab_bucket, CAST(30000 AS INTEGER) AS request_timeout_ms FROM (SELECT request_id, team, {VARIANT} AS bucket FROM requests) x",
    ["requests"],
    ["R1", "R2", "W3", "T17", "T25"],
)
def route_attributes(spark, sf_dir):
    return routing.route_attributes(routed(spark, sf_dir)).select(
        "request_id", "target_service", "target_endpoint", "reason", "model_intent", "ab_enabled", "ab_bucket", "request_timeout_ms"
    )


@query(
    "ab_distribution",
    f"WITH s AS (SELECT team, {VARIANT} AS ab_variant FROM requests), c AS (SELECT team, ab_variant, count(*) AS requests FROM s"
    " WHERE ab_variant IS NOT NULL GROUP BY ALL)"
    " SELECT team, ab_variant, requests, requests::DOUBLE / sum(requests) OVER (PARTITION BY team) AS observed_share,"
    " CASE ab_variant WHEN 'lora-v1' THEN 80 ELSE 20 END::DOUBLE / 100 AS configured_share FROM c",
    ["requests"],
    ["R4", "R1"],
)
def ab_distribution(spark, sf_dir):
    return routing.ab_distribution(routed(spark, sf_dir), routing.read_routes(spark, ROUTE_TABLE))


@query(
    "backend_attributes",
    "SELECT request_id, team || '-api' AS peer_service, k % 7 <> 0 AS ready_at_call, CASE WHEN k % 5 = 0 THEN k % 3 ELSE 0 END AS retries,"
    " CASE WHEN k % 2 = 0 THEN 20000 ELSE 8000 END AS backend_timeout_ms,"
    " CASE WHEN k % 20 = 0 THEN team END AS fallback_from, CASE WHEN k % 20 = 0 THEN 'eval' END AS fallback_to FROM requests",
    ["requests"],
    ["R3"],
)
def backend_attributes(spark, sf_dir):
    calls = v.requests(spark, sf_dir).select(
        "request_id",
        "team",
        F.expr("k % 7 <> 0").alias("ready_at_call"),
        F.expr("CASE WHEN k % 5 = 0 THEN k % 3 END").alias("retries"),
        F.expr("CASE WHEN k % 2 = 0 THEN 20000 END").alias("backend_timeout_ms"),
        F.expr("CASE WHEN k % 10 = 0 THEN team END").alias("fallback_from"),
        F.expr("CASE WHEN k % 4 = 0 THEN 'eval' END").alias("fallback_to"),
    )
    return routing.backend_attributes(calls).drop("team")


@query(
    "request_status",
    "SELECT team, status, CAST(code AS INTEGER) AS code, count(*) AS requests FROM (SELECT team, status, CASE status WHEN 'success' THEN 200"
    " WHEN 'timeout' THEN 504 ELSE 502 END AS code FROM (SELECT team, CASE WHEN latency_ms > 30000 THEN 'timeout'"
    " WHEN status_code >= '400' THEN 'error' ELSE 'success' END AS status FROM requests) x) y GROUP BY ALL",
    ["requests"],
    ["R5", "H2", "T23"],
)
def request_status(spark, sf_dir):
    status = routing.request_status(F.col("status_code").cast("int"), F.col("latency_ms"), F.lit(30000))
    return (
        v.requests(spark, sf_dir)
        .withColumn("status", status)
        .groupBy("team", "status", routing.gateway_code(F.col("status")).alias("code"))
        .agg(F.count(F.lit(1)).alias("requests"))
    )


@query(
    "fallback_rate",
    "WITH c AS (SELECT team, CASE WHEN k % 10 = 0 THEN CASE team WHEN 'eval' THEN 'quant' ELSE 'eval' END END AS fb,"
    " CASE WHEN k % 20 = 0 THEN 'backend_unready' ELSE 'circuit_open' END AS reason FROM requests),"
    " n AS (SELECT team, fb, reason, count(*) AS n FROM c GROUP BY ALL)"
    " SELECT team AS from_team, fb AS to_team, reason, n AS events, rate FROM (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY team) AS rate FROM n) x"
    " WHERE fb IS NOT NULL",
    ["requests"],
    ["R6"],
)
def fallback_rate(spark, sf_dir):
    calls = v.requests(spark, sf_dir).select(
        "team",
        F.expr("CASE WHEN k % 10 = 0 THEN CASE team WHEN 'eval' THEN 'quant' ELSE 'eval' END END").alias("fallback_to"),
        F.expr("CASE WHEN k % 20 = 0 THEN 'backend_unready' ELSE 'circuit_open' END").alias("reason"),
    )
    return routing.fallback_rate(calls)


@query(
    "platform_stats",
    "SELECT count(*) AS requests, CAST(count(*) FILTER (status <> 'success') AS BIGINT) AS errors,"
    " count(*) FILTER (status <> 'success')::DOUBLE / count(*) * 100 AS error_percent FROM requests",
    ["requests"],
    ["A8", "T14"],
)
def platform_stats(spark, sf_dir):
    return routing.platform_stats(v.requests(spark, sf_dir))


@query(
    "platform_stats_by_team",
    "SELECT s.team, requests, errors, error_percent, p50, p95, p99 FROM (SELECT team, count(*) AS requests,"
    " CAST(count(*) FILTER (status <> 'success') AS BIGINT) AS errors,"
    " count(*) FILTER (status <> 'success')::DOUBLE / count(*) * 100 AS error_percent FROM requests GROUP BY team) s JOIN ("
    + q.percentiles("requests", "team", "latency_ms * 1000", {"p50": 500, "p95": 950, "p99": 990})
    + ") p ON p.team = s.team",
    ["requests"],
    ["A8"],
)
def platform_stats_by_team(spark, sf_dir):
    r = v.requests(spark, sf_dir)
    p = compare.latency_percentiles(r, ["team"], {"p50": 500, "p95": 950, "p99": 990})
    return routing.platform_stats(r, ["team"]).join(p, "team")


@query(
    "platform_report",
    "WITH t AS (SELECT team, count(*) AS requests, count(*) FILTER (status <> 'success') AS errors FROM requests GROUP BY team),"
    " g AS (SELECT CAST(sum(requests) AS BIGINT) AS total_requests, sum(errors)::DOUBLE / sum(requests) * 100 AS rate,"
    " '{' || string_agg('\"' || team || '\":' || requests, ',' ORDER BY team) || '}' AS requests_by_team,"
    " '{' || string_agg('\"' || team || '\":' || errors, ',' ORDER BY team) || '}' AS errors_by_team FROM t), p AS ("
    + q.percentiles("requests", "", "latency_ms * 1000", {"p50": 500, "p95": 950, "p99": 990})
    + f") SELECT total_requests, {q.py_round('rate', 2)} AS error_rate_percent, requests_by_team, errors_by_team, "
    + ", ".join(f"{q.py_round(p, 1)} AS {p}_latency_ms" for p in ("p50", "p95", "p99"))
    + " FROM g CROSS JOIN p",
    ["requests"],
    ["A8", "T14"],
)
def platform_report(spark, sf_dir):
    r = v.requests(spark, sf_dir)
    out = routing.platform_report(r, compare.latency_percentiles(r, [], {"p50": 500, "p95": 950, "p99": 990}))
    maps = ("requests_by_team", "errors_by_team")
    return out.withColumns({m: F.to_json(m) for m in maps})


@query(
    "platform_stats_last_day",
    "SELECT team, count(*) AS requests, CAST(count(*) FILTER (status <> 'success') AS BIGINT) AS errors,"
    " count(*) FILTER (status <> 'success')::DOUBLE / count(*) * 100 AS error_percent FROM requests"
    " WHERE us > (SELECT max(us) FROM requests) - 86400000000 GROUP BY team",
    ["requests"],
    ["A8", "T14"],
)
def platform_stats_last_day(spark, sf_dir):
    r = v.requests(spark, sf_dir)
    newest = r.select(F.max("us")).scalar()
    return routing.platform_stats(r.where(F.col("us") > newest - 86400000000), ["team"])


@query(
    "error_type_distribution",
    "SELECT team, status AS error_type, count(*) AS errors FROM requests WHERE status <> 'success' GROUP BY team, status",
    ["requests"],
    ["A21"],
)
def error_type_distribution(spark, sf_dir):
    r = v.requests(spark, sf_dir).withColumn("error_type", F.when(F.col("status") != "success", F.col("status")))
    return routing.error_types(r)


@query(
    "health_status",
    "WITH p AS (SELECT team, arg_max(code, request_id) AS code, max(request_id) AS last_check FROM (SELECT team, request_id,"
    " CASE status WHEN 'success' THEN 200 WHEN 'timeout' THEN 503 ELSE 500 END AS code FROM requests) x GROUP BY team)"
    " SELECT team, CASE code WHEN 200 THEN 'healthy' WHEN 503 THEN 'degraded' ELSE 'unhealthy' END AS status,"
    " CAST(code = 200 AS INTEGER) AS ready_pods, 1 AS total_pods, last_check FROM p",
    ["requests"],
    ["H1", "W6"],
)
def health_status(spark, sf_dir):
    probes = v.requests(spark, sf_dir).select(
        "team",
        F.col("request_id").alias("seq"),
        F.expr("CASE status WHEN 'success' THEN 200 WHEN 'timeout' THEN 503 ELSE 500 END").alias("http_status"),
    )
    return routing.health_status(routing.read_routes(spark, ROUTE_TABLE), probes)


@query(
    "service_inventory",
    f"WITH {ROUTES_SQL}, p AS (SELECT team, '1.0.' || CAST(arg_max(k, request_id) AS VARCHAR) AS version FROM requests WHERE status = 'success' GROUP BY team)"
    " SELECT r.team || '-api' AS name, r.team AS namespace, url, coalesce(version, 'unreachable') AS version FROM routes r LEFT JOIN p ON p.team = r.team"
    " UNION ALL SELECT 'gateway', 'platform', 'http://gateway', 'unknown'",
    ["requests"],
    ["J12", "W6"],
)
def service_inventory(spark, sf_dir):
    versions = (
        v.requests(spark, sf_dir)
        .where("status = 'success'")
        .groupBy("team")
        .agg(F.concat(F.lit("1.0."), F.max_by("k", "request_id").cast("string")).alias("version"))
    )
    gateway = {"url": "http://gateway"}
    return routing.service_inventory(routing.read_routes(spark, ROUTE_TABLE), versions, gateway)
