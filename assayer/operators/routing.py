"""Route table, variant choice, request outcomes, service inventory and health."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from assayer.functions.hashing import hash32
from assayer.functions.numbers import fold_bool, py_round, ratio
from assayer.schemas import ROUTES

DEFAULT_TIMEOUT_MS = 30000
# Model intent by team.
INTENT = {"quant": "quantized", "finetune": "finetuned", "eval": "evaluator"}


def route_table(config: DataFrame, column: str = "config") -> DataFrame:
    """One row per team from the route table's JSON."""
    parsed = config.select(F.from_json(column, ROUTES).alias("r")).select(F.explode("r").alias("team", "route"))
    return parsed.select(
        "team",
        F.col("route.url").alias("url"),
        F.coalesce("route.timeout_ms", F.lit(DEFAULT_TIMEOUT_MS)).alias("timeout_ms"),
        F.col("route.ab_variants").alias("ab_variants"),
    )


def read_routes(spark: SparkSession, text: str) -> DataFrame:
    return route_table(spark.createDataFrame([(text,)], "config string"))


def variant_ranges(routes: DataFrame) -> DataFrame:
    """Half-open weight ranges (lo, hi] per variant in configured order; unweighted teams have none."""
    listed = routes.select("team", F.posexplode(F.map_entries("ab_variants")).alias("pos", "e"))
    w = Window.partitionBy("team").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.coalesce(F.col("e.value.weight"), F.lit(0))
    return (
        listed.select(
            "team",
            F.col("e.key").alias("variant"),
            weight.alias("weight"),
            F.sum(weight).over(w).alias("hi"),
            F.sum(weight).over(Window.partitionBy("team")).alias("total"),
        )
        .withColumn("lo", F.col("hi") - F.col("weight"))
        .where("total > 0 AND weight > 0")
    )


def route_lookup(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Requests with their route; a team without one gets 404."""
    r = routes.select("team", "url", "timeout_ms", F.lit(True).alias("_known"))
    return requests.join(r, "team", "left").withColumn(
        "route_status", F.when(F.col("_known"), 200).otherwise(404)
    ).drop("_known")


def denied(requests: DataFrame, routes: DataFrame) -> DataFrame:
    return requests.join(routes.select("team"), "team", "left_anti")


def select_variant(requests: DataFrame, routes: DataFrame, key: Column) -> DataFrame:
    """Variant by weight, decided by the hash of the request's key and so repeatable."""
    plan = variant_ranges(routes)
    per_team = plan.groupBy("team").agg(
        F.max("total").alias("_total"),
        F.array_sort(F.collect_list(F.struct("hi", "variant"))).alias("_ranges"),
    )
    draw = F.pmod(hash32(key), F.col("_total")) + 1
    chosen = F.element_at(F.filter("_ranges", lambda r: r["hi"] >= F.col("_draw")), 1)["variant"]
    return (
        requests.join(per_team, "team", "left")
        .withColumn("_draw", F.when(F.col("_total").isNotNull(), draw))
        .withColumn("ab_variant", F.when(F.col("_draw").isNotNull(), chosen))
        .drop("_total", "_ranges", "_draw")
    )


def intent_of(team: Column) -> Column:
    out = F.lit("unknown")
    for name, intent in INTENT.items():
        out = F.when(team == name, intent).otherwise(out)
    return out


def route_attributes(requests: DataFrame, policy: str = "default", decision: str = "direct", reason: str = "explicit_path") -> DataFrame:
    """Ingress attributes of each request as columns."""
    team = F.col("team")
    bucket = F.col("ab_variant")
    return requests.withColumns(
        {
            "request_kind": F.lit("predict"),
            "target_service": F.concat(team, F.lit("-api")),
            "target_endpoint": F.concat(F.lit("sagemaker:"), team, F.lit("-endpoint")),
            "policy_id": F.lit(policy),
            "decision": F.lit(decision),
            "reason": F.when(bucket.isNotNull(), "ab_bucket").otherwise(F.lit(reason)),
            "model_intent": intent_of(team),
            "ab_enabled": bucket.isNotNull(),
            "ab_bucket": bucket,
            "request_timeout_ms": F.coalesce("timeout_ms", F.lit(DEFAULT_TIMEOUT_MS)) if "timeout_ms" in requests.columns else F.lit(DEFAULT_TIMEOUT_MS),
        }
    )


def backend_attributes(calls: DataFrame) -> DataFrame:
    """Backend call attributes, among them whether the backend was ready; the fallback pair appears only when both ends are known."""
    both = F.col("fallback_from").isNotNull() & F.col("fallback_to").isNotNull()
    return calls.withColumns(
        {
            "peer_service": F.concat("team", F.lit("-api")),
            "ready_at_call": F.col("ready_at_call"),
            "retries": F.coalesce("retries", F.lit(0)),
            "backend_timeout_ms": F.coalesce("backend_timeout_ms", F.lit(8000)),
            "fallback_from": F.when(both, F.col("fallback_from")),
            "fallback_to": F.when(both, F.col("fallback_to")),
        }
    )


def request_status(http_status: Column, latency_ms: Column, timeout_ms: Column) -> Column:
    """timeout when the call ran out of time, error on an upstream failure, else success."""
    return (
        F.when(latency_ms > timeout_ms, "timeout")
        .when(http_status.isNull() | (http_status >= 400), "error")
        .otherwise("success")
    )


def gateway_code(status: Column) -> Column:
    return F.when(status == "success", 200).when(status == "timeout", 504).otherwise(502)


def ab_distribution(routed: DataFrame, routes: DataFrame) -> DataFrame:
    """Requests per variant, observed and configured share."""
    seen = routed.where(F.col("ab_variant").isNotNull()).groupBy("team", "ab_variant").agg(
        F.count(F.lit(1)).alias("requests")
    )
    plan = variant_ranges(routes).select(
        "team", F.col("variant").alias("ab_variant"), ratio(F.col("weight"), F.col("total")).alias("configured_share")
    )
    total = F.sum("requests").over(Window.partitionBy("team"))
    return plan.join(seen, ["team", "ab_variant"], "left").select(
        "team",
        "ab_variant",
        F.coalesce("requests", F.lit(0)).alias("requests"),
        F.coalesce(ratio(F.col("requests"), total), F.lit(0.0)).alias("observed_share"),
        "configured_share",
    )


def fallback_rate(calls: DataFrame) -> DataFrame:
    """Fallbacks by origin, target and reason, with their share of the origin's calls."""
    n = F.count(F.lit(1))
    grouped = calls.groupBy("team", "fallback_to", "reason").agg(n.alias("n"))
    total = F.sum("n").over(Window.partitionBy("team"))
    return grouped.withColumn("rate", ratio(F.col("n"), total)).where(F.col("fallback_to").isNotNull()).select(
        F.col("team").alias("from_team"), F.col("fallback_to").alias("to_team"), "reason", F.col("n").alias("events"), "rate"
    )


def platform_stats(requests: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals and error percentage, overall or by team; lifetime unless filtered before."""
    failed = F.sum(fold_bool(F.col("status") != "success"))
    total = F.count(F.lit(1))
    return requests.groupBy(*keys).agg(
        total.alias("requests"), failed.alias("errors"), (ratio(failed, total) * 100).alias("error_percent")
    )


def platform_report(requests: DataFrame, percentiles: DataFrame) -> DataFrame:
    """The service's statistics as one row: totals, error percentage, p50, p95, p99 and counts by team, rounded as it does.

    ``percentiles`` has one row. The maps hold one entry per team.
    """
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("team", F.lit("unknown")), c))))
    total, failed = F.sum("requests"), F.sum("errors")
    row = percentiles.select(F.struct("p50", "p95", "p99")).scalar()
    return platform_stats(requests, ["team"]).agg(
        total.alias("total_requests"),
        F.coalesce(py_round(ratio(failed, total) * 100, 2), F.lit(0.0)).alias("error_rate_percent"),
        entries("requests").alias("requests_by_team"),
        entries("errors").alias("errors_by_team"),
    ).select("*", *[F.coalesce(py_round(row[p], 1), F.lit(0.0)).alias(f"{p}_latency_ms") for p in ("p50", "p95", "p99")])


def error_types(calls: DataFrame, keys: Sequence[str] = ("team", "error_type")) -> DataFrame:
    return calls.where(F.col("error_type").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("errors"))


def latest_probe(probes: DataFrame) -> DataFrame:
    """Newest probe per team; two numeric states, so the partial aggregate stays hash based."""
    newest = probes.groupBy("team").agg(
        F.max_by("http_status", "seq").alias("http_status"), F.max("seq").alias("seq")
    )
    return newest


def health_status(routes: DataFrame, probes: DataFrame, teams: Sequence[str] = tuple(INTENT)) -> DataFrame:
    """healthy 200, degraded 503, otherwise unhealthy; unknown for a team without a route."""
    listed = routes.sparkSession.createDataFrame([(t,) for t in teams], "team string")
    known = routes.select("team", F.lit(True).alias("_route"))
    code = F.col("http_status")
    status = (
        F.when(F.col("_route").isNull(), "unknown")
        .when(code == 200, "healthy")
        .when(code == 503, "degraded")
        .otherwise("unhealthy")
    )
    return (
        listed.join(known, "team", "left")
        .join(latest_probe(probes), "team", "left")
        .select(
            "team",
            status.alias("status"),
            F.when(status == "healthy", 1).otherwise(0).alias("ready_pods"),
            F.when(status == "unknown", 0).otherwise(1).alias("total_pods"),
            F.col("seq").alias("last_check"),
        )
    )


def service_inventory(routes: DataFrame, versions: DataFrame, gateway: Mapping[str, str]) -> DataFrame:
    """Routed services with their latest reported version, and the gateway itself."""
    listed = routes.join(versions, "team", "left").select(
        F.concat("team", F.lit("-api")).alias("name"),
        F.col("team").alias("namespace"),
        "url",
        F.coalesce("version", F.lit("unreachable")).alias("version"),
    )
    own = routes.sparkSession.createDataFrame(
        [("gateway", "platform", gateway["url"], gateway.get("version", "unknown"))],
        "name string, namespace string, url string, version string",
    )
    return listed.unionByName(own)
