"""Stand-in views: the provided tables read as prompts, responses, results, requests and spans.

The tables hold none of these, so each view is a fixed rule over whole tables. Every view exists
twice, as a DataFrame and as SQL; expressions both dialects read alike are shared text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

# Seconds of 2024-01-01 00:00 UTC. Metric views run on a clock 60 times as fast from there, so
# that the sparse event table yields samples at scrape density.
ORIGIN_S = 1704067200
SPEED_UP = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TEAM = "CASE user_id % 3 WHEN 0 THEN 'quant' WHEN 1 THEN 'finetune' ELSE 'eval' END"
STATUS = "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'timeout' ELSE 'success' END"
FAST_US = f"({ORIGIN_S}000000 + (us - {ORIGIN_S}000000) {{div}} {SPEED_UP})"

# Shared by both dialects; {team}, {k} and the like are columns of the inner select.
REQUEST_COLUMNS = [
    "request_id",
    "user_id",
    "event_type",
    "team",
    "status",
    "CASE status WHEN 'success' THEN '200' WHEN 'timeout' THEN '504' ELSE '502' END AS status_code",
    "latency_ms",
    "k",
    "CASE WHEN k % 4 = 0 THEN 'mistral-7b-fp16' WHEN team = 'quant' THEN 'mistral-7b-awq'"
    " WHEN team = 'finetune' THEN 'mistral-7b-lora' ELSE 'mistral-7b-judge' END AS app",
    "CASE WHEN team = 'finetune' AND user_id % 5 = 0 THEN 'lora-v2'"
    " WHEN team = 'finetune' THEN 'lora-v1' WHEN team = 'quant' THEN 'awq-7b-v3'"
    " ELSE 'judge-v1' END AS variant_id",
    "CASE team WHEN 'quant' THEN 'awq' WHEN 'finetune' THEN 'lora' ELSE 'judge' END AS variant_type",
    "CASE k % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END AS bucket",
    "CASE k % 4 WHEN 0 THEN 'canary' WHEN 1 THEN 'perf_throughput' WHEN 2 THEN 'quant-quality'"
    " ELSE 'finetune-domain' END AS scenario_id",
    "us",
]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as gateway requests."""
    base = table(spark, sf_dir, "events").selectExpr(
        "event_id AS request_id",
        "user_id",
        "event_type",
        f"{TEAM} AS team",
        f"{STATUS} AS status",
        "CAST(floor(value * 100 + 5e-1) AS BIGINT) AS latency_ms",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
        "unix_micros(CAST(ts AS TIMESTAMP)) AS us",
    )
    return base.selectExpr(*REQUEST_COLUMNS, FAST_US.format(div="div") + " AS fast_us")


RESULT_COLUMNS = [
    "concat('run-', run_no) AS run_id",
    "run_no",
    "CASE run_no % 3 WHEN 0 THEN 'quant' WHEN 1 THEN 'finetune' ELSE 'eval' END AS team",
    "concat('p-', prompt_no) AS prompt_id",
    "line_no",
    "variant",
    "category",
    "error",
    "(error IS NULL AND cheap) AS passed",
    "latency_us / 1e3 AS latency_ms",
    "CASE WHEN error IS NULL THEN tokens ELSE 0 END AS tokens_generated",
    "CASE WHEN tokens * 16 <= 75 THEN 'short' WHEN tokens * 16 <= 300 THEN 'medium'"
    " ELSE 'long' END AS bucket",
    "day",
]
RESULT_BASE = [
    "l_suppkey AS run_no",
    "l_partkey AS prompt_no",
    "l_orderkey * 8 + l_linenumber AS line_no",
    "CASE l_returnflag WHEN 'R' THEN 'fp16' WHEN 'A' THEN 'awq' ELSE 'lora' END AS variant",
    "CASE l_linenumber WHEN 1 THEN 'math' WHEN 2 THEN 'reasoning' WHEN 3 THEN 'code'"
    " WHEN 4 THEN 'factual' WHEN 5 THEN 'long_form' WHEN 6 THEN 'medical' END AS category",
    "CASE WHEN l_tax >= 0.075 THEN 'upstream timeout' END AS error",
    "l_discount < 0.045 AS cheap",
    "CAST(floor(l_extendedprice * 100 + 5e-1) AS BIGINT) AS latency_us",
    "CAST(l_quantity AS BIGINT) AS tokens",
]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as harness results: supplier = run, part = prompt, return flag = variant."""
    return (
        table(spark, sf_dir, "lineitem")
        .selectExpr(*RESULT_BASE, "CAST(unix_date(CAST(l_shipdate AS DATE)) AS BIGINT) AS day")
        .selectExpr(*RESULT_COLUMNS)
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as prompts."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id"),
        F.concat(F.lit("b-"), "item_id").alias("prompt_id"),
        F.col("text").alias("prompt"),
        F.floor(F.length("text") / 4).alias("target_output_tokens"),
        F.filter(F.slice(F.split("text", " "), 1, 2), lambda t: t != "").alias("expected_contains"),
        F.when(F.col("item_id") % 10 == 9, "json").alias("expected_format"),
        F.expr(CATEGORY).alias("category"),
    )


CATEGORY = (
    "CASE item_id % 5 WHEN 0 THEN 'math' WHEN 1 THEN 'reasoning' WHEN 2 THEN 'code'"
    " WHEN 3 THEN 'factual' END"
)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as recorded answers: run = doc_id div n, prompt = doc_id mod n, n prompts."""
    n = table(spark, sf_dir, "benchmark").select(F.count(F.lit(1))).scalar()
    docs = table(spark, sf_dir, "documents").withColumn("n", n)
    return docs.select(
        F.expr("concat('r-', doc_id div n)").alias("run_id"),
        F.expr("concat('b-', doc_id % n)").alias("prompt_id"),
        F.col("doc_id").alias("line_no"),
        F.expr("CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END").alias("output"),
        F.expr("CASE WHEN doc_id % 14 = 0 THEN '{\"answer\": ' || doc_id || '}' WHEN doc_id % 7 = 0 THEN text END").alias(
            "response"
        ),
        F.expr("n_chars + doc_id % 50 * 2e1").alias("latency_ms"),
        F.expr("CASE WHEN doc_id % 3 = 0 THEN n_chars div 5 END").alias("tokens_generated"),
        F.expr("CASE WHEN doc_id % 11 = 0 THEN 'HTTP 502' END").alias("error"),
        F.col("source"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as prompt/response pairs: a user turn and the assistant turn after it."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt")
    )
    answered = turns.where("role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("response")
    )
    return asked.join(answered, ["conv_id", "turn"])


# The judge's text in five shapes: clean, fenced, truncated, junk, one rubric missing.
RAW_JUDGEMENT = (
    "CASE doc_id % 5"
    " WHEN 0 THEN concat('{{\"coherence\": ', coh, ', \"helpfulness\": ', hel, ', \"factuality\": ', fac,"
    " ', \"toxicity\": ', tox, ', \"reasoning\": \"ok\"}}')"
    " WHEN 1 THEN concat('```json', chr(10), '{{\"coherence\": ', coh, ', \"helpfulness\": ', hel,"
    " ', \"factuality\": ', fac, ', \"toxicity\": ', tox, '}}', chr(10), '```')"
    " WHEN 2 THEN concat('{{\"coherence\": ', coh, ', \"helpfulness\": ', hel, ', \"fact')"
    " WHEN 3 THEN 'I would rate this highly.'"
    " ELSE concat('{{\"coherence\": ', coh, ', \"helpfulness\": ', hel, ', \"toxicity\": ', tox, '}}') END"
).replace("{{", "{").replace("}}", "}")
SCORES = [
    "concat('0.', lpad(CAST(60 + doc_id % 37 AS STRING), 2, '0')) AS coh",
    "concat('0.', lpad(CAST(60 + 20 * coalesce(quality, 0) + doc_id % 13 AS STRING), 2, '0')) AS hel",
    "concat('0.', lpad(CAST(55 + doc_id % 41 AS STRING), 2, '0')) AS fac",
    "concat('0.', lpad(CAST(2 + 20 * coalesce(toxic, 0) + doc_id % 10 AS STRING), 2, '0')) AS tox",
]


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their labels as raw judge outputs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels")
    return (
        docs.join(labels, "doc_id", "left")
        .selectExpr("doc_id", "text", "lang", "source", "quality", "toxic", *SCORES)
        .selectExpr(
            "doc_id",
            "text",
            "source AS variant",
            "lang AS promptset_id",
            "doc_id % 30 AS day",
            "CASE WHEN doc_id % 3 = 0 THEN 'strict-v1' WHEN doc_id % 3 = 1 THEN 'daily-gate-v1'"
            " ELSE 'unknown-profile' END AS profile",
            "quality",
            "toxic",
            f"{RAW_JUDGEMENT} AS raw",
        )
    )


# The same views for the checking engine, in its own dialect.
VIEWS = {
    "requests": (
        "SELECT " + ", ".join(REQUEST_COLUMNS) + ", " + FAST_US.format(div="//") + " AS fast_us FROM ("
        f"SELECT event_id AS request_id, user_id, event_type, {TEAM} AS team, {STATUS} AS status,"
        " CAST(floor(value * 100 + 5e-1) AS BIGINT) AS latency_ms,"
        " CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us FROM events) e"
    ),
    "results": (
        "SELECT " + ", ".join(RESULT_COLUMNS) + " FROM (SELECT "
        + ", ".join(RESULT_BASE)
        + ", date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day FROM lineitem) l"
    ),
    "prompts": (
        "SELECT item_id, concat('b-', item_id) AS prompt_id, text AS prompt,"
        " length(text) // 4 AS target_output_tokens,"
        " list_filter(string_split(text, ' ')[1:2], lambda t: t <> '') AS expected_contains,"
        " CASE WHEN item_id % 10 = 9 THEN 'json' END AS expected_format,"
        f" {CATEGORY} AS category FROM benchmark"
    ),
    "responses": (
        "SELECT concat('r-', doc_id // n) AS run_id, concat('b-', doc_id % n) AS prompt_id,"
        " doc_id AS line_no, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS output,"
        " CASE WHEN doc_id % 14 = 0 THEN '{\"answer\": ' || doc_id || '}'"
        " WHEN doc_id % 7 = 0 THEN text END AS response,"
        " n_chars + doc_id % 50 * 2e1 AS latency_ms,"
        " CASE WHEN doc_id % 3 = 0 THEN n_chars // 5 END AS tokens_generated,"
        " CASE WHEN doc_id % 11 = 0 THEN 'HTTP 502' END AS error, source"
        " FROM documents, (SELECT count(*) AS n FROM benchmark) c"
    ),
    "pairs": (
        "SELECT u.conv_id, a.turn, u.text AS prompt, a.text AS response FROM conversations u"
        " JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1"
        " WHERE u.role = 'user' AND a.role = 'assistant'"
    ),
    "judgements": (
        "SELECT doc_id, text, source AS variant, lang AS promptset_id, doc_id % 30 AS day,"
        " CASE WHEN doc_id % 3 = 0 THEN 'strict-v1' WHEN doc_id % 3 = 1 THEN 'daily-gate-v1'"
        f" ELSE 'unknown-profile' END AS profile, quality, toxic, {RAW_JUDGEMENT} AS raw FROM ("
        "SELECT doc_id, text, lang, source, quality, toxic, " + ", ".join(SCORES)
        + " FROM documents d LEFT JOIN labels l USING (doc_id)) x"
    ),
}


def with_views(sql: str, views: Sequence[str]) -> str:
    """Prefix SQL with the definitions of the views it reads."""
    if not views:
        return sql
    parts = ", ".join(f"{name} AS ({VIEWS[name]})" for name in views)
    body = sql.lstrip()
    for lead in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(lead):
            return f"{lead}{parts}, {body[len(lead):]}"
    return f"WITH {parts} {body}"
