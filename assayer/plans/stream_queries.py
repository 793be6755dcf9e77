"""Streaming queries, run to the end of the available data and read back from their tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from assayer.functions.labels import all_match
from assayer.operators import runs, telemetry
from assayer.plans import metric_standins as ms, panels
from assayer.plans import standins as v
from assayer.plans.dataset_queries import folder
from assayer.plans.registry import query
from assayer.plans.telemetry_queries import log_lines
from assayer.sources import signals, sinks
from assayer.streaming import rules, state, windows

NOW = {"availableNow": True}
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
LINEITEM = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,"
    " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
)


class _Streams:
    """The reader the stand-in views expect, yielding streams."""

    def __init__(self, spark):
        self.read = self
        self.spark = spark

    def parquet(self, path: str):
        name = path.rsplit("/", 1)[-1]
        schema = EVENTS if name.startswith("events") else LINEITEM
        # A stream source takes a single file only through a pattern; a directory matches as well.
        return self.spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def requests(spark, sf_dir):
    return v.requests(_Streams(spark), sf_dir).withColumn("ts", F.timestamp_micros("fast_us"))


def finish(q):
    q.awaitTermination()


def appended(spark, stream, name: str):
    path = folder(spark, name)
    finish(windows.to_table(stream, f"{path}/table", f"{path}/checkpoint", **NOW))
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


# Windows are final once the watermark (newest time less one minute) has passed their end.
CLOSED = "(SELECT max(fast_us) // 1000 * 1000 - 60000000 FROM requests)"


@query(
    "stream_sliding_requests",
    "SELECT team, w AS window_end_s, CAST(sum(n) AS BIGINT) AS total FROM (SELECT team, unnest(range(s + 30, s + 301, 30)) AS w, n FROM"
    f" (SELECT team, fast_us // 30000000 * 30 AS s, count(*) AS n FROM requests GROUP BY ALL) x) y WHERE w * 1000000 <= {CLOSED} GROUP BY team, w",
    ["requests"],
    ["T-a", "M8", "T-i"],
)
def stream_sliding_requests(spark, sf_dir):
    out = windows.sliding_totals(requests(spark, sf_dir), ["team"], "5 minutes", "30 seconds", "1 minute")
    return appended(spark, out, "sliding").select("team", F.unix_seconds("window_end").alias("window_end_s"), "total")


@query(
    "stream_hourly_tokens",
    "SELECT app, w AS window_end_s, CAST(sum(n) AS BIGINT) AS total FROM (SELECT app, unnest(range(s + 900, s + 3601, 900)) AS w, n FROM"
    f" (SELECT app, fast_us // 900000000 * 900 AS s, sum(k) AS n FROM requests GROUP BY ALL) x) y WHERE w * 1000000 <= {CLOSED} GROUP BY app, w",
    ["requests"],
    ["T-b"],
)
def stream_hourly_tokens(spark, sf_dir):
    out = windows.sliding_totals(requests(spark, sf_dir), ["app"], "1 hour", "15 minutes", "1 minute", F.col("k"))
    return appended(spark, out, "hourly").select("app", F.unix_seconds("window_end").alias("window_end_s"), "total")


@query(
    "stream_daily_status",
    "SELECT status, d * 86400 AS day_s, count(*) AS requests FROM (SELECT status, us // 86400000000 AS d FROM requests) x"
    " WHERE (d + 1) * 86400000000 <= (SELECT max(us) // 1000 * 1000 - 3600000000 FROM requests) GROUP BY status, d",
    ["requests"],
    ["T-c"],
)
def stream_daily_status(spark, sf_dir):
    r = v.requests(_Streams(spark), sf_dir).withColumn("ts", F.timestamp_micros("us"))
    out = windows.tumbling(r, ["status"], "1 day", "1 hour", [F.count(F.lit(1)).alias("requests")])
    flat = out.select("status", F.unix_seconds("window.start").alias("day_s"), "requests")
    return appended(spark, flat, "daily")


@query(
    "stream_completed_traces",
    "WITH g AS (SELECT user_id, fast_us, sum(b) OVER (PARTITION BY user_id ORDER BY fast_us, request_id) AS s FROM (SELECT *, CASE WHEN fast_us - lag(fast_us) OVER"
    " (PARTITION BY user_id ORDER BY fast_us, request_id) < 10000000 THEN 0 ELSE 1 END AS b FROM requests) x)"
    " SELECT 'u' || user_id AS trace_id, min(fast_us) AS start_us, max(fast_us) + 10000000 AS end_us, count(*) AS spans FROM g GROUP BY user_id, s"
    f" HAVING max(fast_us) + 10000000 <= {CLOSED}",
    ["requests"],
    ["T-e"],
)
def stream_completed_traces(spark, sf_dir):
    r = requests(spark, sf_dir).withColumn("trace_id", F.concat(F.lit("u"), "user_id"))
    out = windows.completed_traces(r, "1 minute")
    flat = out.select("trace_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "spans")
    return appended(spark, flat, "traces")


def sample_stream(spark, sf_dir, metric: str, path: str):
    """Samples reach the stream through a table, as a scrape would have written them."""
    samples = ms.samples(spark, sf_dir, metric).withColumn("ts", F.timestamp_seconds("t"))
    samples.write.mode("overwrite").parquet(f"{path}/in")
    return spark.readStream.schema(samples.schema).parquet(f"{path}/in")


@query(
    "stream_counter_gains",
    "WITH s AS (" + ms.samples_sql("gateway_requests_total") + "), g AS (SELECT team, status, lag(t) OVER w AS from_t, t, CASE WHEN value < lag(value) OVER w THEN value"
    " ELSE value - lag(value) OVER w END AS gain FROM s WINDOW w AS (PARTITION BY team, status ORDER BY t))"
    " SELECT team, status, from_t, t, gain FROM g WHERE gain IS NOT NULL AND t < (SELECT max(t) FROM s)",
    ["requests"],
    ["T-h", "M2"],
)
def stream_counter_gains(spark, sf_dir):
    # A bucket for each scrape, so that only the gains of the newest one still wait.
    path = folder(spark, "samples")
    stream = sample_stream(spark, sf_dir, "gateway_requests_total", path)
    gains = state.counter_gains(stream, ["team", "status"], "0 seconds", bucket_s=ms.spec_of("gateway_requests_total")[0].tick)
    with state.rocksdb(spark):
        finish(windows.to_table(gains, f"{path}/out", f"{path}/checkpoint", **NOW))
    out = spark.read.schema(gains.schema).parquet(f"{path}/out")
    return out.select("team", "status", "from_t", "t", "gain")


def rule_samples(spark, sf_dir, rule, path: str):
    """(stream of the samples a rule reads, labels of their series); two metrics share a stream, marked by ``is_num``."""
    first = sample_stream(spark, sf_dir, rule.metric, f"{path}/first").where(all_match(rule.where))
    series = ms.series_of(rule.metric)
    if rule.kind != "over":
        return first, series
    where = rule.where if rule.other_where is None else rule.other_where
    second = sample_stream(spark, sf_dir, rule.other, f"{path}/second").where(all_match(where))
    both = first.withColumn("is_num", F.lit(True)).unionByName(second.withColumn("is_num", F.lit(False)), allowMissingColumns=True)
    return both, list(dict.fromkeys([*series, *ms.series_of(rule.other), "is_num"]))


def _streamed_rule(name: str):
    """A stored rule on a stream of its samples, up to the newest evaluation time that is complete."""
    rule = next(p for p in panels.RECORDING_RULES if p.name == name)
    labels = " || chr(44) || ".join(rule.by)
    newest = " UNION ALL ".join(f"SELECT t FROM ({ms.samples_sql(x)}) z" for x in (rule.metric, rule.other) if x)
    sql = f"SELECT {labels} AS labels, eval_t, value FROM ({panels.panel_sql(rule)}) r WHERE eval_t <= (SELECT max(t) FROM ({newest}) y)"

    @query("stream_" + name, sql, ["requests"], ["M8", "T-a", "T-i"])
    def build(spark, sf_dir):
        path = folder(spark, name)
        samples, series = rule_samples(spark, sf_dir, rule, path)
        by, parts = panels.stream_parts(rule)
        vectors = rules.windowed_gains(samples, series, by, rule.window, rule.step, "0 seconds", parts)
        with state.rocksdb(spark):
            finish(rules.rule_to_table(vectors, lambda v: panels.finished(rule, v), f"{path}/out", f"{path}/checkpoint", **NOW))
        out = spark.read.parquet(f"{path}/out")
        return out.select(F.concat_ws(",", *rule.by).alias("labels"), "eval_t", "value")

    return build


STREAMED_RULES = (
    "rule_http_request_rate", "rule_http_error_ratio", "rule_http_latency_p95", "rule_pod_restarts_increase",
    "rule_variant_tokens_per_second",
)
for _name in STREAMED_RULES:
    _streamed_rule(_name)


def run_changes(spark, sf_dir):
    """Each result as a change of its run: its place, the status it leaves the run in, and one finished call."""
    return v.results(_Streams(spark), sf_dir).select(
        "run_id",
        F.col("line_no").alias("seq"),
        F.when(F.col("error").isNull(), "running").otherwise("failed").alias("status"),
        F.lit(1).cast("bigint").alias("done"),
        F.timestamp_seconds(F.col("day") * 86400).alias("ts"),
    )


@query(
    "stream_run_state",
    "SELECT run_id, line_no AS seq, CASE WHEN error IS NULL THEN 'running' ELSE 'failed' END AS status, done FROM results r"
    " JOIN (SELECT run_id, max(line_no) AS line_no, count(*) AS done FROM results GROUP BY run_id) m USING (run_id, line_no)",
    ["results"],
    ["T-g"],
)
def stream_run_state(spark, sf_dir):
    path = folder(spark, "runs")
    states = state.run_states(run_changes(spark, sf_dir).drop("ts"))
    with state.rocksdb(spark):
        finish(windows.updates_to_table(states, f"{path}/out", f"{path}/checkpoint", **NOW))
    return runs.newest_state(spark.read.parquet(f"{path}/out").drop("batch")).select("run_id", "seq", "status", "done")


# Runs of one prompt each: a prompt's results of one day. They end with their last result.
DAILY_RUNS = "SELECT concat(run_id, '/', day) AS run_id, line_no, error, day FROM results"
KEEP_DAYS = 7  # fixed value: days after which an ended run is forgotten


@query(
    "stream_expired_runs",
    f"WITH d AS ({DAILY_RUNS}), r AS (SELECT run_id, max(line_no) AS seq, count(*) AS done, max(day) AS day, arg_max(error, line_no) AS error,"
    " arg_max(CASE WHEN error IS NULL THEN 0 ELSE 1 END, line_no) AS bad FROM d GROUP BY run_id)"
    " SELECT run_id, seq, CASE bad WHEN 1 THEN 'failed' ELSE 'running' END AS status, done, bad = 1 AND day + 7 <= (SELECT max(day) FROM results) AS expired FROM r",
    ["results"],
    ["T-g"],
)
def stream_expired_runs(spark, sf_dir):
    """Which runs the stream has forgotten at its end: failed ones, a week of event time after their last change."""
    path = folder(spark, "expired")
    changes = run_changes(spark, sf_dir).withColumn("run_id", F.concat_ws("/", "run_id", F.unix_date(F.to_date("ts"))))
    states = state.run_states(changes, keep_ms=KEEP_DAYS * 86_400_000)
    with state.rocksdb(spark):
        finish(windows.updates_to_table(states, f"{path}/out", f"{path}/checkpoint", **NOW))
    return runs.newest_state(spark.read.parquet(f"{path}/out").drop("batch"))


@query(
    "stream_late_rejects",
    "SELECT count(*) FILTER (us >= n - 604800000000) AS accepted, count(*) FILTER (us < n - 604800000000) AS rejected FROM requests,"
    " (SELECT 1706659200000000 AS n) c",
    ["requests"],
    ["T-d"],
)
def stream_late_rejects(spark, sf_dir):
    r = v.requests(_Streams(spark), sf_dir).withColumn("ts", F.timestamp_micros("us"))
    path = folder(spark, "late")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    finish(windows.reject_late(r, now, f"{path}/accepted", f"{path}/rejected", f"{path}/checkpoint", **NOW))
    accepted = spark.read.parquet(f"{path}/accepted").agg(F.count(F.lit(1)).alias("accepted"))
    rejected = spark.read.parquet(f"{path}/rejected").agg(F.sum("rejected"))
    return accepted.withColumn("rejected", rejected.scalar())


@query(
    "stream_replayed_requests",
    "SELECT team, count(*) AS requests FROM requests GROUP BY team",
    ["requests"],
    ["T-d"],
)
def stream_replayed_requests(spark, sf_dir):
    # The same file twice stands for a replay; each request must count once.
    both = requests(spark, sf_dir).unionByName(requests(spark, sf_dir))
    out = windows.once(both, ["request_id"], "1 hour").select("request_id", "team")
    return appended(spark, out, "replay").groupBy("team").agg(F.count(F.lit(1)).alias("requests"))


@query(
    "stream_log_sink",
    "SELECT severity, us // 86400000000 AS day, count(*) AS lines FROM (SELECT CASE status WHEN 'success' THEN 'INFO' WHEN 'timeout' THEN 'WARNING' ELSE 'ERROR' END"
    " AS severity, us + latency_ms * 500 AS us FROM requests) x WHERE us >= 1704067200000000 + 23 * 86400000000 GROUP BY ALL",
    ["requests"],
    ["S13", "S7", "T-f"],
)
def stream_log_sink(spark, sf_dir):
    lines = log_lines(_Streams(spark), sf_dir).select("severity", "line", F.timestamp_micros("ts_us").alias("ts"))
    path = folder(spark, "logs")
    finish(sinks.signal_sink(lines, path, f"{path}/checkpoint", "logs", **NOW))
    table = spark.read.parquet(f"{path}/logs")
    kept = sinks.retained(table, F.lit("2024-01-31 00:00:00"), sinks.RETENTION_DAYS["logs"])
    return kept.groupBy("severity", F.unix_date("date").cast("bigint").alias("day")).agg(F.count(F.lit(1)).alias("lines"))


@query(
    "stream_logs_with_traces",
    "SELECT l.request_id, t.request_id AS opened_by FROM requests l JOIN requests t ON l.user_id = t.user_id AND t.event_type = 'view'"
    " AND l.event_type = 'error' AND l.fast_us >= t.fast_us AND l.fast_us <= t.fast_us + 30000000",
    ["requests"],
    ["J8"],
)
def stream_logs_with_traces(spark, sf_dir):
    r = requests(spark, sf_dir).withColumn("trace_id", F.concat(F.lit("u"), "user_id"))
    lines = r.where("event_type = 'error'").select("trace_id", "request_id", F.col("ts").alias("log_ts"))
    traces = r.where("event_type = 'view'").select("trace_id", F.col("request_id").alias("opened_by"), F.col("ts").alias("trace_ts"))
    out = windows.logs_joined_traces(lines, traces, "1 minute", "30 SECONDS").select("request_id", "opened_by")
    return appended(spark, out, "joined")


# Each request as the signals it leaves: a latency metric, a log line and its gateway span.
SIGNAL_KINDS = ("metrics", "logs", "traces")
NOW_DAY = datetime.date(2024, 1, 31)


def signals_of(r):
    """Signals with all kinds' columns, a third of them of each kind."""
    text = lambda c: c.cast("string")
    own = r.withColumns({
        "ts": F.timestamp_micros("us"),
        "end_ts": F.timestamp_micros(F.col("us") + F.col("latency_ms") * 1000),
        "pod": F.expr("concat(team, '-api-', user_id % 7)"),
        "resource": F.create_map(F.lit("service.name"), F.concat("team", F.lit("-api"))),
        "attributes": F.create_map(F.lit("request.id"), text(F.col("request_id"))),
        "name": F.lit("gateway"),
        "value": F.col("latency_ms").cast("double"),
        "line": F.concat_ws(" ", "status", text(F.col("request_id"))),
        "trace_id": F.concat(F.lit("u"), text(F.col("user_id"))),
        "span_id": F.concat(F.lit("g"), text(F.col("request_id"))),
        "parent_span_id": F.lit(None).cast("string"),
        "kind": F.explode(F.array(*map(F.lit, SIGNAL_KINDS))),
    })
    columns = sorted({c for names in sinks.SIGNAL_COLUMNS.values() for c in names})
    return own.select("kind", "pod", *columns)


def signal_tables(spark, sf_dir, name: str) -> str:
    """The tables of all kinds, written by one stream; pods are known but for two of seven."""
    path = folder(spark, name)
    r = v.requests(spark, sf_dir).where("user_id % 7 < 5")
    pods = r.groupBy(F.expr("concat(team, '-api-', user_id % 7)").alias("pod")).agg(F.min(F.expr("user_id % 7")).alias("n"))
    pods = pods.select("pod", F.create_map(F.lit("k8s.node.name"), F.concat(F.lit("node-"), F.col("n").cast("string"))).alias("metadata"))
    stream = signals_of(v.requests(_Streams(spark), sf_dir))
    finish(sinks.fan_out(stream, path, f"{path}/checkpoint", lambda b: telemetry.enrich(b, pods, "test").drop("pod"), **NOW))
    return path


@query(
    "stream_signal_sinks",
    "SELECT kind, us // 86400000000 AS day, count(*) AS signals, CAST(sum(latency_ms) FILTER (kind = 'metrics') AS DOUBLE) AS total, count(*) FILTER (user_id % 7 < 5) AS placed"
    " FROM requests, (SELECT unnest(['metrics', 'logs', 'traces']) AS kind) k GROUP BY ALL",
    ["requests"],
    ["S13", "J11"],
)
def stream_signal_sinks(spark, sf_dir):
    path = signal_tables(spark, sf_dir, "signals")
    parts = [
        spark.read.parquet(f"{path}/{kind}").select(
            F.lit(kind).alias("kind"), "date", "resource", (F.col("value") if kind == "metrics" else F.lit(None).cast("double")).alias("value")
        )
        for kind in SIGNAL_KINDS
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    placed = F.col("resource")["k8s.node.name"].isNotNull() & (F.col("resource")["deployment.environment"] == "test")
    return out.groupBy("kind", F.unix_date("date").cast("bigint").alias("day")).agg(
        F.count(F.lit(1)).alias("signals"), F.sum("value").alias("total"), F.count(F.when(placed, 1)).alias("placed")
    )


@query(
    "stream_retention",
    "SELECT kind, first_day, signals FROM (SELECT kind, min(us // 86400000000) FILTER (us // 86400000000 >= 19753 - keep - 1) AS first_day,"
    " count(*) FILTER (us >= (19753 - keep) * 86400000000) AS signals FROM requests,"
    " (SELECT unnest(['metrics', 'logs', 'traces']) AS kind, unnest([15, 7, 2]) AS keep) k GROUP BY kind, keep) x",
    ["requests"],
    ["T-f", "S13"],
)
def stream_retention(spark, sf_dir):
    """The oldest day whose files are left after expired ones are dropped, and the signals that readers see."""
    path = signal_tables(spark, sf_dir, "retention")
    sinks.drop_expired(spark, path, NOW_DAY)
    now = F.lit(NOW_DAY.isoformat())
    parts = []
    for kind, days in sinks.RETENTION_DAYS.items():
        table = spark.read.parquet(f"{path}/{kind}")
        shown = sinks.retained(table, now, days).agg(F.count(F.lit(1)).alias("signals"))
        first = table.agg(F.min(F.unix_date("date")).cast("bigint")).scalar()
        parts.append(shown.select(F.lit(kind).alias("kind"), first.alias("first_day"), "signals"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "stream_spans_from_files",
    "SELECT team || '-api' AS service, count(*) AS spans, CAST(sum(latency_ms) AS BIGINT) AS total_ms, count(*) FILTER (status <> 'success') AS failed FROM requests GROUP BY team",
    ["requests"],
    ["S7"],
)
def stream_spans_from_files(spark, sf_dir):
    """Spans as a collector leaves them in files, read as a stream of the schema for spans."""
    path = folder(spark, "span-files")
    r = signals_of(v.requests(spark, sf_dir)).where("kind = 'traces'")
    failed = F.split_part("line", F.lit(" "), F.lit(1)) != "success"
    events = F.when(failed, F.array(F.struct(F.lit("exception").alias("name"), F.col("attributes"))))
    spans = r.select(
        "trace_id", "span_id", "parent_span_id", "name", F.col("resource")["service.name"].alias("service"),
        F.col("ts").alias("start_ts"), "end_ts", "resource", "attributes", events.alias("events"),
    )
    spans.write.parquet(f"{path}/in")
    read = signals.read_signals(spark, "spans", f"{path}/in")
    stored = read.select("service", (F.unix_millis("end_ts") - F.unix_millis("start_ts")).alias("ms"), F.size("events").alias("n"))
    finish(windows.to_table(stored, f"{path}/out", f"{path}/checkpoint", **NOW))
    out = spark.read.schema(stored.schema).parquet(f"{path}/out")
    return out.groupBy("service").agg(
        F.count(F.lit(1)).alias("spans"), F.sum("ms").alias("total_ms"), F.count(F.when(F.col("n") > 0, 1)).alias("failed")
    )
