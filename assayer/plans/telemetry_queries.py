"""Queries on spans and logs, read off the request view."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from assayer.functions.labels import Match, relabel
from assayer.operators import logs, telemetry, tracing
from assayer.plans import standins as v
from assayer.plans.dataset_queries import folder
from assayer.plans.registry import query
from assayer.plans.sqltext import py_round
from assayer.sources import signals, spanstore

POD = "concat(team, '-api-', user_id % 7)"

# Three spans per request: gateway, team service, model call. A trace is a user's hour.
SPAN_ROWS = [
    # service, own id, parent id, share of the latency
    ("'gateway'", "'g'", "NULL", "latency_ms * 1000"),
    ("team || '-api'", "'s'", "'g'", "latency_ms * 900"),
    ("team || '-endpoint'", "'m'", "'s'", "latency_ms * 700"),
]
SPANS_SQL = (
    "spans AS ("
    + " UNION ALL ".join(
        f"SELECT substr(sha256(user_id || ':' || us // 3600000000), 1, 32) AS trace_id, substr(sha256({own} || request_id), 1, 16) AS span_id,"
        f" substr(sha256({parent} || request_id), 1, 16) AS parent_span_id, {service} AS service, {POD} AS pod, us AS start_us,"
        f" us + {took} AS end_us, status, request_id FROM requests"
        for service, own, parent, took in SPAN_ROWS
    )
    + ")"
)


def spans(spark, sf_dir):
    return spans_of(v.requests(spark, sf_dir))


def spans_of(r, *more: str):
    """All three spans of a request from one scan, with further columns of the request."""
    rid = F.col("request_id").cast("string")

    def sid(prefix: str):
        return F.substring(F.sha2(F.concat(F.lit(prefix), rid), 256), 1, 16)

    def row(service, own, parent, num):
        return F.struct(
            sid(own).alias("span_id"),
            (sid(parent) if parent else F.lit(None).cast("string")).alias("parent_span_id"),
            service.alias("service"),
            (F.col("us") + F.col("latency_ms") * num).alias("end_us"),
        )

    rows = F.array(
        row(F.lit("gateway"), "g", None, 1000),
        row(F.concat("team", F.lit("-api")), "s", "g", 900),
        row(F.concat("team", F.lit("-endpoint")), "m", "s", 700),
    )
    trace = F.substring(F.sha2(F.expr("user_id || ':' || us div 3600000000"), 256), 1, 32)
    return r.select(
        trace.alias("trace_id"), F.col("us").alias("start_us"), "status", "request_id", "team", "k",
        "variant_id", "variant_type", F.expr(POD).alias("pod"), *more, F.inline(rows),
    )


@query(
    "service_edges",
    f"WITH {SPANS_SQL} SELECT p.service AS from_service, c.service AS to_service, count(*) AS calls,"
    " CAST(count(*) FILTER (c.status = 'error') AS BIGINT) AS errors, CAST(sum(c.end_us - c.start_us) AS BIGINT) AS total_us"
    " FROM spans c JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id GROUP BY ALL",
    ["requests"],
    ["J10"],
)
def service_edges(spark, sf_dir):
    return telemetry.service_edges(spans(spark, sf_dir))


# The same spans as long calls: a request's gateway span is called by the request before it in the trace. Now and then
# the caller's own span was lost, or a span names one below it as its parent.
LINKED_SQL = (
    "linked AS (SELECT * FROM (SELECT s.trace_id, s.span_id, CASE WHEN s.service <> 'gateway' THEN s.parent_span_id"
    " WHEN s.request_id % 53 = 0 THEN substr(sha256('m' || s.request_id), 1, 16) ELSE p.before END AS parent_span_id, s.service, s.start_us,"
    " s.end_us, s.request_id FROM spans s JOIN (SELECT request_id, substr(sha256('g' || lag(request_id) OVER (PARTITION BY user_id, us // 3600000000"
    " ORDER BY us, request_id)), 1, 16) AS before FROM requests) p USING (request_id)) x WHERE NOT (request_id % 17 = 0 AND service = 'gateway'))"
)


def linked_spans(spark, sf_dir):
    r = v.requests(spark, sf_dir)
    trace = Window.partitionBy("user_id", F.expr("us div 3600000000")).orderBy("us", "request_id")
    sid = lambda prefix, rid: F.substring(F.sha2(F.concat(F.lit(prefix), rid.cast("string")), 256), 1, 16)
    r = r.withColumn("before", sid("g", F.lag("request_id").over(trace)))
    called = F.when(F.col("service") != "gateway", F.col("parent_span_id")).when(F.col("request_id") % 53 == 0, sid("m", F.col("request_id")))
    return (
        spans_of(r, "before")
        .where("NOT (request_id % 17 = 0 AND service = 'gateway')")
        .select("trace_id", "span_id", called.otherwise(F.col("before")).alias("parent_span_id"), "service", "start_us", "end_us")
    )


TREES_SQL = (
    f"{SPANS_SQL}, {LINKED_SQL}, known AS (SELECT l.*, p.span_id IS NOT NULL AS found FROM linked l LEFT JOIN linked p"
    " ON p.trace_id = l.trace_id AND p.span_id = l.parent_span_id),"
    " tree AS (SELECT trace_id, span_id, span_id AS root_span_id, 0::BIGINT AS depth, parent_span_id IS NOT NULL AS orphaned FROM known WHERE NOT found"
    " UNION ALL SELECT k.trace_id, k.span_id, t.root_span_id, t.depth + 1, t.orphaned FROM known k JOIN tree t ON k.trace_id = t.trace_id AND k.parent_span_id = t.span_id),"
    " kids AS (SELECT p.trace_id, p.span_id, least(greatest(c.start_us, p.start_us), p.end_us) AS a, least(greatest(c.end_us, p.start_us), p.end_us) AS b"
    " FROM linked c JOIN linked p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id),"
    " cover AS (SELECT trace_id, span_id, count(*) AS children, CAST(sum(greatest(0, b - greatest(a, coalesce(reached, a)))) AS BIGINT) AS us FROM (SELECT *,"
    " max(b) OVER (PARTITION BY trace_id, span_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM kids) x GROUP BY trace_id, span_id),"
    " trees AS (SELECT l.trace_id, l.span_id, root_span_id, depth, CASE WHEN t.span_id IS NULL THEN 'circular' WHEN orphaned THEN 'orphaned' ELSE 'rooted' END AS link,"
    " coalesce(children, 0) AS children, l.end_us - l.start_us - coalesce(us, 0) AS self_us FROM linked l LEFT JOIN tree t ON t.trace_id = l.trace_id AND t.span_id = l.span_id"
    " LEFT JOIN cover c ON c.trace_id = l.trace_id AND c.span_id = l.span_id)"
)


@query("span_trees", f"WITH RECURSIVE {TREES_SQL} SELECT * FROM trees", ["requests"], ["J10"])
def span_trees(spark, sf_dir):
    return tracing.span_trees(linked_spans(spark, sf_dir))


@query(
    "span_tree_summary",
    f"WITH RECURSIVE {TREES_SQL} SELECT trace_id, count(*) AS spans, count(*) FILTER (depth = 0) AS roots, max(depth) AS deepest,"
    " count(*) FILTER (link = 'orphaned') AS orphaned, count(*) FILTER (link = 'circular') AS circular, CAST(sum(self_us) AS BIGINT) AS self_us FROM trees GROUP BY trace_id",
    ["requests"],
    ["J10", "T-e"],
)
def span_tree_summary(spark, sf_dir):
    return tracing.tree_summary(tracing.span_trees(linked_spans(spark, sf_dir)))


@query(
    "trace_summary",
    f"WITH {SPANS_SQL} SELECT trace_id, count(*) AS spans, min(start_us) AS start_us, max(end_us) AS end_us,"
    " CAST(count(*) FILTER (status = 'error') AS BIGINT) AS errors FROM spans GROUP BY trace_id",
    ["requests"],
    ["J10", "T-e"],
)
def trace_summary(spark, sf_dir):
    return telemetry.trace_summary(spans(spark, sf_dir))


@query(
    "genai_metrics",
    "SELECT request_id, k + 10 AS total_tokens, CASE WHEN k > 0 THEN latency_ms // k END AS tpot_ms,"
    " CASE WHEN k > 0 THEN " + py_round("k::DOUBLE / latency_ms * 1000", 1)
    + " END AS tokens_per_sec, CASE WHEN k % 2 = 0 THEN latency_ms // 8 END AS ttft_ms FROM requests",
    ["requests"],
    ["G1", "G2", "T24"],
)
def genai_metrics(spark, sf_dir):
    calls = v.requests(spark, sf_dir).select(
        "request_id",
        F.lit(10).cast("bigint").alias("input_tokens"),
        F.col("k").alias("output_tokens"),
        F.col("latency_ms").alias("duration_ms"),
        "us",
        F.when(F.col("k") % 2 == 0, F.col("us") + F.col("latency_ms") * 125).alias("first_us"),
    )
    out = telemetry.genai_metrics(calls).withColumn("ttft_ms", telemetry.ttft_ms(F.col("us"), F.col("first_us")))
    return out.select("request_id", "total_tokens", "tpot_ms", "tokens_per_sec", "ttft_ms")


@query(
    "resource_attributes",
    "SELECT request_id, team || '-api' AS service_name, team || '-api-local' AS instance, CASE WHEN k % 3 = 0 THEN 'unknown' ELSE "
    + POD
    + " END AS pod_name, 'dev' AS environment, 12::BIGINT AS n_keys FROM requests",
    ["requests"],
    ["G3"],
)
def resource_attributes(spark, sf_dir):
    r = v.requests(spark, sf_dir)
    pod = F.when(F.col("k") % 3 != 0, F.expr(POD))
    out = telemetry.resource_attributes(r, {"k8s.pod.name": pod}, F.concat("team", F.lit("-api")), F.col("team"))
    res = F.col("resource")
    return out.select(
        "request_id",
        res["service.name"].alias("service_name"),
        res["service.instance.id"].alias("instance"),
        res["k8s.pod.name"].alias("pod_name"),
        res["deployment.environment"].alias("environment"),
        F.size(res).cast("bigint").alias("n_keys"),
    )


@query(
    "redacted_calls",
    "SELECT conv_id, turn, substr(sha256(prompt), 1, 16) AS prompt_hash, substr(sha256(response), 1, 16) AS completion_hash,"
    " CASE WHEN conv_id % 4 = 0 THEN 'vault-' || conv_id ELSE 'not_stored' END AS prompt_ref FROM pairs"
    " WHERE CAST(('0x' || substr(sha256('t' || conv_id), 1, 8)) AS UBIGINT) % 10000 < 2500",
    ["pairs"],
    ["G4", "G5", "T26"],
)
def redacted_calls(spark, sf_dir):
    calls = v.pairs(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.concat(F.lit("t"), "conv_id").alias("trace_id"),
        "prompt",
        F.col("response").alias("completion"),
        F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("vault-"), "conv_id")).alias("prompt_ref"),
        F.lit(None).cast("string").alias("completion_ref"),
    )
    # A quarter of the traces instead of one in a hundred, so that small data has some.
    kept = telemetry.redact(calls, 2500).where(F.size("events") > 0)
    first, second = F.col("events")[0]["attributes"], F.col("events")[1]["attributes"]
    return kept.select(
        "conv_id", "turn", first["genai.prompt.hash"].alias("prompt_hash"),
        second["genai.completion.hash"].alias("completion_hash"), first["lab.payload.encrypted_ref"].alias("prompt_ref"),
    )


def attributed(spark, sf_dir):
    """Gateway and service spans with an attribute map, some keys left out on purpose."""
    r = v.requests(spark, sf_dir)

    def m(*entries):
        flat = [x for key, value in entries for x in (F.lit(key), value.cast("string"))]
        return F.map_filter(F.create_map(*flat), lambda _, x: x.isNotNull())

    gateway = m(
        ("lab.request.kind", F.lit("predict")),
        ("lab.route.target.team", F.col("team")),
        ("lab.route.decision", F.when(F.col("k") % 10 == 0, "routed").otherwise("direct")),
        ("lab.route.reason", F.when(F.col("k") % 10 == 0, "path_match").otherwise("explicit_path")),
        ("lab.route.policy.id", F.when(F.col("k") % 6 != 0, F.lit("default"))),
        ("lab.backend.retries", F.lit("0")),
        ("lab.backend.timeout.ms", F.lit("30000")),
        ("lab.ab.enabled", F.when(F.col("team") == "finetune", "true").otherwise("false")),
        ("lab.ab.bucket", F.when((F.col("team") == "finetune") & (F.col("k") % 4 != 0), F.col("variant_id"))),
    )
    service = m(
        ("lab.model.variant.type", F.col("variant_type")),
        ("lab.model.variant.id", F.col("variant_id")),
        ("genai.usage.input_tokens", F.lit("10")),
        ("genai.usage.output_tokens", F.when(F.col("status") != "error", F.col("k"))),
        ("lab.sagemaker.endpoint.name", F.concat("team", F.lit("-endpoint"))),
        ("lab.status", F.col("status")),
        ("error.type", F.when((F.col("status") == "error") & (F.col("k") % 3 != 0), "http_5xx").when(F.col("status") == "timeout", "timed_out")),
        ("prompt", F.when(F.col("k") == 7, F.repeat(F.lit("x"), 250))),
    )
    rows = F.array(
        F.struct(F.lit("gateway").alias("component"), gateway.alias("attributes")),
        F.struct(F.lit("service").alias("component"), service.alias("attributes")),
    )
    return r.select("request_id", "team", F.inline(rows))


@query(
    "missing_attributes",
    "SELECT request_id, component, missing FROM (SELECT request_id, 'gateway' AS component, concat_ws(',', CASE WHEN k % 6 = 0 THEN 'lab.route.policy.id' END,"
    " CASE WHEN team = 'finetune' AND k % 4 = 0 THEN 'lab.ab.bucket' END) AS missing FROM requests UNION ALL"
    " SELECT request_id, 'service', concat_ws(',', CASE WHEN status = 'error' THEN 'genai.usage.output_tokens' END,"
    " CASE WHEN status = 'error' AND k % 3 = 0 THEN 'error.type' END) FROM requests) x WHERE missing <> ''",
    ["requests"],
    ["G6"],
)
def missing_attributes(spark, sf_dir):
    out = telemetry.missing_attributes(attributed(spark, sf_dir)).where(F.size("missing") > 0)
    return out.select("request_id", "component", F.array_join("missing", ",").alias("missing"))


@query(
    "enum_violations",
    "SELECT key, value, count(*) AS spans FROM (SELECT 'lab.route.decision' AS key, 'routed' AS value FROM requests WHERE k % 10 = 0"
    " UNION ALL SELECT 'lab.route.reason', 'path_match' FROM requests WHERE k % 10 = 0"
    " UNION ALL SELECT 'error.type', 'timed_out' FROM requests WHERE status = 'timeout') x GROUP BY key, value",
    ["requests"],
    ["G7", "T25"],
)
def enum_violations(spark, sf_dir):
    return telemetry.enum_violations(attributed(spark, sf_dir))


@query(
    "raw_text_guard",
    "SELECT 'gateway' AS component, count(*) AS signals, 0::BIGINT AS forbidden_key, 0::BIGINT AS overlong_value FROM requests"
    " UNION ALL SELECT 'service', count(*), count(*) FILTER (k = 7), count(*) FILTER (k = 7) FROM requests",
    ["requests"],
    ["G8"],
)
def raw_text_guard(spark, sf_dir):
    return telemetry.raw_text_guard(attributed(spark, sf_dir), ["component"])


@query(
    "baggage_headers",
    "SELECT request_id, concat_ws(',', 'lab.route.policy.id=default', CASE WHEN team = 'finetune' THEN 'lab.ab.bucket=' || variant_id END,"
    " CASE WHEN k % 2 = 0 THEN 'lab.promptset.id=set-' || k END) AS header, CASE WHEN team = 'finetune' THEN variant_id END AS bucket_back FROM requests",
    ["requests"],
    ["G9"],
)
def baggage_headers(spark, sf_dir):
    bag = telemetry.baggage(
        {
            "lab.route.policy.id": F.lit("default"),
            "lab.ab.bucket": F.when(F.col("team") == "finetune", F.col("variant_id")),
            "lab.experiment.id": F.lit(""),
            "lab.promptset.id": F.when(F.col("k") % 2 == 0, F.concat(F.lit("set-"), F.col("k").cast("string"))),
        }
    )
    out = v.requests(spark, sf_dir).select("request_id", telemetry.baggage_header(bag).alias("header"))
    back = F.try_element_at(telemetry.parse_baggage(F.col("header")), F.lit("lab.ab.bucket"))
    return out.withColumn("bucket_back", back)


# ---- logs ------------------------------------------------------------------------------------------

LOG_SQL = (
    "logs AS (SELECT request_id, team AS namespace, team || '-api' AS service, " + POD + " AS pod, us + latency_ms * 500 AS ts_us,"
    " CASE status WHEN 'success' THEN 'INFO' WHEN 'timeout' THEN 'WARNING' ELSE 'ERROR' END AS severity,"
    " CASE status WHEN 'success' THEN 'predict ok' WHEN 'timeout' THEN 'warn: slow backend' ELSE 'error: exceeded quota' END AS message,"
    " CASE WHEN k % 5 <> 0 THEN substr(sha256(user_id || ':' || us // 3600000000), 1, 32) END AS trace_id,"
    " CASE WHEN k % 5 <> 0 THEN substr(sha256('s' || request_id), 1, 16) END AS span_id, k, status FROM requests)"
)
LINE_SQL = (
    "lines AS (SELECT *, '{\"timestamp\":\"' || ts_us || '\",\"severity\":\"' || severity || '\",\"message\":\"' || message || '\",\"logger\":\"api\",\"service.name\":\"'"
    " || service || '\",\"lab.team\":\"' || namespace || '\"' || coalesce(',\"trace_id\":\"' || trace_id || '\",\"span_id\":\"' || span_id || '\"', '')"
    " || ',\"lab.k\":\"' || k || '\"' || CASE WHEN status = 'error' THEN ',\"error.type\":\"QuotaError\",\"error.message\":\"q' || k || '\"' ELSE '' END || '}' AS line FROM logs)"
)


def log_lines(spark, sf_dir):
    base = v.requests(spark, sf_dir).select(
        "request_id",
        F.col("team").alias("namespace"),
        F.concat("team", F.lit("-api")).alias("service"),
        F.expr(POD).alias("pod"),
        F.expr("us + latency_ms * 500").alias("ts_us"),
        F.expr("CASE status WHEN 'success' THEN 'INFO' WHEN 'timeout' THEN 'WARNING' ELSE 'ERROR' END").alias("severity"),
        F.expr(
            "CASE status WHEN 'success' THEN 'predict ok' WHEN 'timeout' THEN 'warn: slow backend' ELSE 'error: exceeded quota' END"
        ).alias("message"),
        F.expr("CASE WHEN k % 5 <> 0 THEN substr(sha2(user_id || ':' || us div 3600000000, 256), 1, 32) END").alias("trace_id"),
        F.expr("CASE WHEN k % 5 <> 0 THEN substr(sha2('s' || request_id, 256), 1, 16) END").alias("span_id"),
        "k",
        "status",
    )
    failed = F.col("status") == "error"
    line = logs.format_log(
        F.col("ts_us").cast("string"), F.col("severity"), F.col("message"), F.lit("api"), F.col("service"),
        F.col("namespace"), F.col("trace_id"), F.col("span_id"),
        extra=F.create_map(F.lit("lab.k"), F.col("k").cast("string")),
        error_type=F.when(failed, "QuotaError"),
        error_message=F.when(failed, F.concat(F.lit("q"), F.col("k").cast("string"))),
    )
    # Exploded, so that conditions on a line are not pushed below it and a line is built once per row.
    return base.withColumn("line", F.explode(F.array(line)))


@query("formatted_logs", f"WITH {LOG_SQL}, {LINE_SQL} SELECT request_id, line FROM lines", ["requests"], ["L1"])
def formatted_logs(spark, sf_dir):
    return log_lines(spark, sf_dir).select("request_id", "line")


@query(
    "parsed_logs",
    f"WITH {LOG_SQL} SELECT request_id, severity, service AS service_name, trace_id, 'q' || CASE WHEN status = 'error' THEN k END AS error_message FROM logs",
    ["requests"],
    ["S9"],
)
def parsed_logs(spark, sf_dir):
    parsed = logs.parse_logs(
        log_lines(spark, sf_dir).select("request_id", "line"), promoted=["severity", "service.name", "trace_id", "error.message"]
    )
    return parsed.select("request_id", "severity", "service_name", "trace_id", "error_message")


@query(
    "log_lines_from_files",
    f"WITH {LOG_SQL} SELECT severity, service AS service_name, count(*) AS lines, count(trace_id) AS traced FROM logs GROUP BY ALL",
    ["requests"],
    ["S9", "L1"],
)
def log_lines_from_files(spark, sf_dir):
    path = folder(spark, "log-files")
    log_lines(spark, sf_dir).select("line").write.text(path)
    back = signals.read_log_lines(spark, path)
    return back.groupBy("severity", "service_name").agg(F.count(F.lit(1)).alias("lines"), F.count("trace_id").alias("traced"))


@query(
    "selected_error_lines",
    f"WITH {LOG_SQL}, {LINE_SQL} SELECT namespace, count(*) AS lines FROM lines WHERE namespace IN ('platform', 'quant', 'finetune', 'eval')"
    " AND (contains(line, 'error') OR contains(line, 'warn')) GROUP BY namespace",
    ["requests"],
    ["L2"],
)
def selected_error_lines(spark, sf_dir):
    out = logs.select_lines(
        log_lines(spark, sf_dir), [Match("namespace", "=~", "platform|quant|finetune|eval")], contains=["error", "warn"]
    )
    return out.groupBy("namespace").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "selected_quota_lines",
    f"WITH {LOG_SQL}, {LINE_SQL} SELECT request_id, line FROM lines WHERE namespace = 'quant' AND contains(line, 'exceeded quota')"
    " AND regexp_matches(line, 'bench|benchmark|harness|predict|quota')",
    ["requests"],
    ["L2"],
)
def selected_quota_lines(spark, sf_dir):
    out = logs.select_lines(
        log_lines(spark, sf_dir), [Match("namespace", "=", "quant")], ["exceeded quota"], "bench|benchmark|harness|predict|quota"
    )
    return out.select("request_id", "line")


@query(
    "platform_benchmark_lines",
    f"WITH {LOG_SQL}, {LINE_SQL} SELECT request_id FROM lines WHERE k % 4 = 0 AND regexp_matches(line, 'bench|benchmark|harness|predict')",
    ["requests"],
    ["L2"],
)
def platform_benchmark_lines(spark, sf_dir):
    """The shipped panel's selection; every fourth request's line counts as the platform's own."""
    lines = log_lines(spark, sf_dir).withColumn("namespace", F.when(F.col("k") % 4 == 0, "platform").otherwise(F.col("namespace")))
    return logs.select_lines(lines, [Match("namespace", "=", "platform")], regex="bench|benchmark|harness|predict").select("request_id")


@query(
    "harness_run_lines",
    "SELECT prompt_id || ' ' || CASE WHEN passed THEN 'true' ELSE 'false' END || ' ' || CAST(floor(latency_ms) AS BIGINT) || 'ms' AS text"
    " FROM results WHERE run_no % 10 = 3",
    ["results"],
    ["L3"],
)
def harness_run_lines(spark, sf_dir):
    """A run's lines of the harness log, formatted; ten groups of runs stand for its runs."""
    r = v.results(spark, sf_dir).select(
        F.lit("test-harness").alias("job"),
        F.to_json(F.struct(
            F.concat(F.lit("run-"), F.col("run_no") % 10).alias("lab_run_id"),
            F.col("prompt_id").alias("lab_prompt_id"),
            F.col("passed").cast("string").alias("passed"),
            F.col("latency_ms").cast("bigint").cast("string").alias("latency_ms"),
        )).alias("line"),
    )
    lines = logs.select_lines(r, [Match("job", "=", "test-harness")], ["run-3"])
    parsed = logs.read_fields(lines, ["lab_run_id", "lab_prompt_id", "passed", "latency_ms"])
    mine = parsed.where(logs.field("lab_run_id") == "run-3")
    return mine.select(logs.line_format("%s %s %sms", ["lab_prompt_id", "passed", "latency_ms"]).alias("text"))


@query(
    "harness_trace_search",
    "SELECT run_id, prompt_id FROM results WHERE run_no % 10 = 3 AND category = 'math'",
    ["results"],
    ["L4"],
)
def harness_trace_search(spark, sf_dir):
    """Harness spans by service, scenario and run; categories stand for scenarios."""
    s = v.results(spark, sf_dir).select(
        "run_id",
        "prompt_id",
        F.create_map(F.lit("service.name"), F.lit("test-harness")).alias("resource"),
        F.create_map(
            F.lit("lab.scenario.id"), F.col("category"), F.lit("lab.run.id"), F.concat(F.lit("run-"), F.col("run_no") % 10)
        ).alias("attributes"),
    )
    found = telemetry.search(s, {"service.name": "test-harness"}, {"lab.scenario.id": "math", "lab.run.id": "run-3"})
    return found.select("run_id", "prompt_id")


@query(
    "formatted_error_lines",
    f"WITH {LOG_SQL} SELECT request_id, coalesce(trace_id, '') || ' QuotaError: ' || message AS text FROM logs WHERE severity = 'ERROR'",
    ["requests"],
    ["L3"],
)
def formatted_error_lines(spark, sf_dir):
    # A parsed severity can only be ERROR where the raw line holds the word: most lines are never parsed.
    lines = logs.select_lines(log_lines(spark, sf_dir), [Match("service", "=~", "quant-api|finetune-api|eval-api")], ["ERROR"])
    parsed = logs.read_fields(lines.select("request_id", "line"), ["severity", "trace_id", "error.type", "message"])
    errors = parsed.where(logs.field("severity") == "ERROR")
    return errors.select("request_id", logs.line_format("%s %s: %s", ["trace_id", "error.type", "message"]).alias("text"))


@query(
    "trace_search",
    "SELECT request_id, variant_id FROM requests WHERE team = 'finetune' AND variant_id = 'lora-v2'",
    ["requests"],
    ["L4"],
)
def trace_search(spark, sf_dir):
    s = attributed(spark, sf_dir).where("component = 'service'")
    s = s.withColumn("resource", F.create_map(F.lit("service.name"), F.concat("team", F.lit("-api"))))
    hits = telemetry.search(s, {"service.name": "finetune-api"}, {"lab.model.variant.id": "lora-v2"})
    return hits.select("request_id", F.col("attributes")["lab.model.variant.id"].alias("variant_id"))


@query(
    "logs_with_traces",
    f"WITH {SPANS_SQL}, {LOG_SQL}, t AS (SELECT trace_id, count(*) AS spans, min(start_us) AS start_us FROM spans GROUP BY trace_id)"
    " SELECT request_id, l.trace_id, spans, start_us FROM logs l JOIN t ON t.trace_id = l.trace_id",
    ["requests"],
    ["J8"],
)
def logs_with_traces(spark, sf_dir):
    traces = telemetry.trace_summary(spans(spark, sf_dir))
    lines = log_lines(spark, sf_dir).select("request_id", "line")
    return telemetry.logs_with_traces(lines, traces).select("request_id", "trace_id", "spans", "start_us")


@query(
    "logs_in_spans",
    f"WITH {SPANS_SQL}, {LOG_SQL} SELECT s.span_id, s.service, l.request_id AS log_id FROM spans s JOIN logs l"
    " ON l.service = s.service AND l.pod = s.pod AND l.ts_us BETWEEN s.start_us AND s.end_us",
    ["requests"],
    ["J9"],
)
def logs_in_spans(spark, sf_dir):
    s = spans(spark, sf_dir).select("span_id", "service", "pod", "start_us", "end_us")
    lines = log_lines(spark, sf_dir).select("service", "pod", "ts_us", F.col("request_id").alias("log_id"))
    return telemetry.logs_in_spans(s, lines).select("span_id", "service", "log_id")


@query(
    "enriched_signals",
    "SELECT request_id, CASE WHEN user_id % 7 < 5 THEN 'node-' || user_id % 7 END AS node, 'test' AS environment,"
    " CASE WHEN user_id % 7 < 5 THEN team ELSE 'unset' END AS team_label FROM requests",
    ["requests"],
    ["J11"],
)
def enriched_signals(spark, sf_dir):
    r = v.requests(spark, sf_dir).withColumns(
        {"pod": F.expr(POD), "resource": F.create_map(F.lit("team"), F.lit("unset"))}
    )
    # Two of the seven pods of a team are unknown to the metadata.
    pods = (
        r.where("user_id % 7 < 5")
        .select("pod", F.create_map(F.lit("k8s.node.name"), F.expr("'node-' || user_id % 7"), F.lit("team"), F.col("team")).alias("metadata"))
        .groupBy("pod")
        .agg(F.any_value("metadata").alias("metadata"))
    )
    out = telemetry.enrich(r, pods, "test")
    res = F.col("resource")
    return out.select(
        "request_id",
        F.try_element_at(res, F.lit("k8s.node.name")).alias("node"),
        res["deployment.environment"].alias("environment"),
        res["team"].alias("team_label"),
    )


# Static labels of the four model targets.
TARGETS = {
    "mistral-7b-awq": {"app": "mistral-7b-awq", "scrape_team": "quantization"},
    "mistral-7b-fp16": {"app": "mistral-7b-fp16", "scrape_team": "reference"},
    "mistral-7b-lora": {"app": "mistral-7b-lora", "scrape_team": "finetuning"},
    "mistral-7b-judge": {"app": "mistral-7b-judge", "scrape_team": "evaluation"},
}


@query(
    "target_labels",
    "SELECT app, CASE app WHEN 'mistral-7b-awq' THEN 'quantization' WHEN 'mistral-7b-fp16' THEN 'reference' WHEN 'mistral-7b-lora' THEN 'finetuning'"
    " ELSE 'evaluation' END AS scrape_team, count(*) AS samples FROM requests GROUP BY ALL",
    ["requests"],
    ["S8"],
)
def target_labels(spark, sf_dir):
    samples = v.requests(spark, sf_dir).select(F.col("app").alias("target"), "request_id")
    out = signals.with_target_labels(samples, TARGETS)
    return out.groupBy("app", "scrape_team").agg(F.count(F.lit(1)).alias("samples"))


RELABEL = [
    {"source_labels": ["scrape"], "action": "keep", "regex": "true"},
    {"source_labels": ["address", "port"], "action": "replace", "regex": r"([^:]+)(?::\d+)?;(\d+)", "replacement": "$1:$2", "target_label": "address"},
    {"source_labels": ["meta_namespace"], "action": "replace", "target_label": "namespace"},
]


@query(
    "relabelled_targets",
    "SELECT request_id, CASE WHEN k % 2 = 0 THEN 'pod' || user_id || ':' || 8000 + k ELSE 'pod' || user_id || ':9090' END AS address, team AS namespace"
    " FROM requests WHERE k % 3 <> 0",
    ["requests"],
    ["P18"],
)
def relabelled_targets(spark, sf_dir):
    r = v.requests(spark, sf_dir).select(
        "request_id",
        F.expr("CASE WHEN k % 3 <> 0 THEN 'true' ELSE 'false' END").alias("scrape"),
        F.expr("'pod' || user_id || ':9090'").alias("address"),
        F.expr("CASE WHEN k % 2 = 0 THEN CAST(8000 + k AS STRING) ELSE '' END").alias("port"),
        F.col("team").alias("meta_namespace"),
    )
    return relabel(r, RELABEL).select("request_id", "address", "namespace")


@query(
    "stored_trace_search",
    "SELECT request_id, variant_id, day FROM (SELECT *, us // 86400000000 AS day FROM requests) r WHERE team = 'finetune' AND variant_id = 'lora-v2'"
    " AND day BETWEEN 19723 AND 19737",
    ["requests"],
    ["L4", "J8"],
)
def stored_trace_search(spark, sf_dir):
    """The search over a stored table: team, variant and days are conditions on columns of the files."""
    path = folder(spark, "span-store")
    s = attributed(spark, sf_dir).where("component = 'service'")
    s = s.withColumn("resource", F.create_map(F.lit("service.name"), F.concat("team", F.lit("-api"))))
    own = s.join(spans(spark, sf_dir).where("service = team || '-api'").select("request_id", "trace_id", "span_id", "start_us"), "request_id")
    spanstore.write_spans(own.select("request_id", "trace_id", "span_id", "start_us", "resource", "attributes"), path, F.timestamp_micros("start_us"))
    hits = spanstore.find(
        spark.read.parquet(path), {"service.name": "finetune-api"}, {"lab.model.variant.id": "lora-v2"}, ("2024-01-01", "2024-01-15")
    )
    return hits.select("request_id", F.col("lab_model_variant_id").alias("variant_id"), F.unix_date("date").cast("bigint").alias("day"))
