"""Queries on prompt datasets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assayer.functions.text import BYTE_LEVEL_PART, approx_tokens, normalised, token_counter
from assayer.operators import datasets, sketches
from assayer.plans import sqltext as q
from assayer.plans import standins as v
from assayer.plans.registry import query
from assayer.session import shared_dir
from assayer.shared import saved, stored
from assayer.sources import promptsets, sinks

# documents as raw prompts: source = dataset, language = scenario; every ninth has no target.
DOC_PROMPTS = (
    "doc_prompts AS (SELECT doc_id AS line_no, concat('d-', doc_id) AS prompt_id, text AS prompt, source AS dataset_id, lang AS scenario_id,"
    " CASE WHEN doc_id % 9 <> 0 THEN n_chars // 4 END AS target, CASE WHEN coalesce(CASE WHEN doc_id % 9 <> 0 THEN n_chars // 4 END, 50) <= 75"
    " THEN 'short' WHEN coalesce(CASE WHEN doc_id % 9 <> 0 THEN n_chars // 4 END, 50) <= 300 THEN 'medium' ELSE 'long' END AS bucket FROM documents)"
)


def doc_prompts(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("line_no"),
        F.concat(F.lit("d-"), "doc_id").alias("prompt_id"),
        F.col("text").alias("prompt"),
        F.col("lang").alias("scenario_id"),
        F.expr("CASE WHEN doc_id % 9 <> 0 THEN n_chars div 4 END").alias("target_output_tokens"),
        "source",
    )


def normalised_prompts(spark, sf_dir):
    docs = doc_prompts(spark, sf_dir)
    with_set = docs.withColumn("dataset_id", F.col("source"))
    return datasets.normalise_prompts(with_set, F.col("scenario_id"), F.col("dataset_id"))


@query(
    "normalised_prompts",
    f"WITH {DOC_PROMPTS} SELECT prompt_id, 'bench-v1' AS scenario_id, 'bench' AS dataset_id, target AS target_output_tokens, bucket,"
    " scenario_id AS source_scenario, sha256(prompt) AS prompt_digest FROM doc_prompts",
    [],
    ["P1", "P2", "T9", "T11"],
)
def normalised_prompts_query(spark, sf_dir):
    out = datasets.normalise_prompts(doc_prompts(spark, sf_dir), "bench-v1", "bench")
    return out.select(
        "prompt_id", "scenario_id", "dataset_id", "target_output_tokens", "bucket",
        F.col("metadata")["source_scenario"].alias("source_scenario"), F.sha2("prompt", 256).alias("prompt_digest"),
    )


@query(
    "numbered_prompts",
    "SELECT doc_id, source || '-' || CASE WHEN n < 100 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS prompt_id,"
    " CAST(CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 200 END AS BIGINT) AS target_output_tokens FROM"
    " (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) x",
    [],
    ["D1", "W1"],
)
def numbered_prompts(spark, sf_dir):
    rows = v.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("doc_id").alias("line_no"),
        F.col("source").alias("prefix"),
        F.split("text", " ").alias("expected"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN n_chars END").alias("max_tokens"),
    )
    return datasets.expand(rows).select("doc_id", "prompt_id", "target_output_tokens")


def _draw(slot: int, low: int, high: int) -> str:
    return f"({q.hash32(f'concat_ws(chr(58), 42, o_orderkey, {slot})')} % {high - low + 1} + {low})"


@query(
    "arithmetic_prompts",
    "SELECT o_orderkey, CASE o_orderkey % 6"
    " WHEN 0 THEN 'Calculate ' || m0 || ' * ' || m1 || '.' WHEN 1 THEN 'What is ' || p0 || '^' || p1 || '?'"
    " WHEN 2 THEN 'What is ' || d0 || ' divided by ' || d1 || '? Give the integer part.'"
    " WHEN 3 THEN 'What is ' || pct || '% of ' || w || '?' WHEN 4 THEN 'Calculate (' || a || ' + ' || b || ') * ' || c || '.' ELSE 'What is ' || s0 || ' + ' || s1 || '?' END AS prompt,"
    " CAST(CASE o_orderkey % 6 WHEN 0 THEN m0 * m1 WHEN 1 THEN CAST(pow(p0, p1) AS BIGINT) WHEN 2 THEN d0 // d1"
    " WHEN 3 THEN pct * w // 100 WHEN 4 THEN (a + b) * c ELSE s0 + s1 END AS VARCHAR) AS answer FROM (SELECT o_orderkey, "
    f"{_draw(0, 10, 99)}::BIGINT AS m0, {_draw(1, 10, 99)}::BIGINT AS m1, {_draw(0, 2, 9)}::BIGINT AS p0, {_draw(1, 2, 5)}::BIGINT AS p1,"
    f" {_draw(0, 100, 999)}::BIGINT AS d0, {_draw(1, 2, 20)}::BIGINT AS d1, [10, 15, 20, 25, 30, 40, 50, 60, 75, 80][{_draw(0, 1, 10)}::INTEGER]::BIGINT AS pct,"
    f" {_draw(1, 50, 500)}::BIGINT * 2 AS w, {_draw(0, 2, 20)}::BIGINT AS a, {_draw(1, 2, 20)}::BIGINT AS b, {_draw(2, 2, 20)}::BIGINT AS c, {_draw(0, 1, 100)}::BIGINT AS s0, {_draw(1, 1, 100)}::BIGINT AS s1 FROM orders) x",
    [],
    ["D2"],
)
def arithmetic_prompts(spark, sf_dir):
    keys = v.table(spark, sf_dir, "orders").select("o_orderkey")
    out = datasets.arithmetic_prompts(keys, "o_orderkey")
    return out.select("o_orderkey", "prompt", F.element_at("expected_contains", 1).alias("answer"))


@query(
    "pair_prompts",
    "SELECT 'Which segment is ' || c_name || ' in?' AS prompt, c_mktsegment AS answer FROM customer",
    [],
    ["D3"],
)
def pair_prompts(spark, sf_dir):
    out = datasets.pair_prompts(v.table(spark, sf_dir, "customer"), "Which segment is %s in?", "c_name", "c_mktsegment")
    return out.select("prompt", F.element_at("expected_contains", 1).alias("answer"))


@query(
    "template_prompts",
    "SELECT p_partkey, length, 'Write a ' || length || ' summary of ' || p_name || '.' AS prompt,"
    " CASE length WHEN 'one-sentence' THEN 50 WHEN 'paragraph' THEN 200 ELSE 800 END::BIGINT AS target_output_tokens,"
    " CASE length WHEN 'one-sentence' THEN 'short' WHEN 'paragraph' THEN 'medium' ELSE 'long' END AS bucket"
    " FROM part, (SELECT unnest(['one-sentence', 'paragraph', 'detailed']) AS length) l",
    [],
    ["D4", "J14", "S11"],
)
def template_prompts(spark, sf_dir):
    topics = v.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("topic"))
    lengths = {"one-sentence": 50, "paragraph": 200, "detailed": 800}
    out = datasets.expand_templates(
        topics, "Write a {length} summary of {topic}.", "topic", {"length": list(lengths)}, "length", lengths
    )
    return out.drop("topic")


MERGED = (
    "merged AS (SELECT 'synthetic' AS source, 2 AS priority, 'd-' || doc_id AS prompt_id, text AS prompt, doc_id * 2 AS line_no FROM documents WHERE lang <> 'en'"
    " UNION ALL SELECT 'curated', 1, 'd-' || doc_id, text, doc_id * 2 FROM documents WHERE lang = 'en'"
    " UNION ALL SELECT 'template', 0, 'b-' || item_id, text, item_id * 2 + 1 FROM benchmark)"
)


def merged_sources(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d-"), "doc_id").alias("prompt_id"), F.col("text").alias("prompt"), (F.col("doc_id") * 2).alias("line_no"), "lang"
    )
    items = v.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b-"), "item_id").alias("prompt_id"), F.col("text").alias("prompt"), (F.col("item_id") * 2 + 1).alias("line_no")
    )
    return datasets.merge_sources(
        {"template": items, "curated": docs.where("lang = 'en'").drop("lang"), "synthetic": docs.where("lang <> 'en'").drop("lang")}
    )


@query(
    "merged_sources",
    f"WITH {MERGED} SELECT source, count(*) AS prompts, CAST(sum(length(prompt)) AS BIGINT) AS chars FROM merged GROUP BY source",
    [],
    ["U1", "U2"],
)
def merged_sources_query(spark, sf_dir):
    return merged_sources(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("prompts"), F.sum(F.length("prompt")).alias("chars")
    )


@query(
    "deduplicated_prompts",
    f"WITH {MERGED}, k AS (SELECT *, sha256({q.normalised('prompt')}) AS text_key FROM merged)"
    " SELECT text_key, prompt_id, source, copies FROM (SELECT *, count(*) OVER (PARTITION BY text_key) AS copies,"
    " row_number() OVER (PARTITION BY text_key ORDER BY priority, prompt_id) AS n FROM k) x WHERE n = 1",
    [],
    ["D7"],
)
def deduplicated_prompts(spark, sf_dir):
    out = datasets.deduplicate(merged_sources(spark, sf_dir), "prompt", "priority", "prompt_id")
    return out.select("text_key", "prompt_id", "source", "copies")


SPLIT = (
    "CASE WHEN {h} < 700 THEN 'train' WHEN {h} < 900 THEN 'eval_holdout' ELSE 'canary_never_train' END"
)
DOC_SPLIT = SPLIT.format(h=f"{q.hash32('concat_ws(chr(58), 7, ' + q.normalised('text') + ')')} % 1000")


@query(
    "split_assignment",
    f"SELECT doc_id, {DOC_SPLIT} AS split FROM documents",
    [],
    ["D5"],
)
def split_assignment(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents")
    return docs.select("doc_id", datasets.split_of(normalised(F.col("text")), datasets.DOMAIN_SPLITS, 7).alias("split"))


@query(
    "split_leakage",
    f"WITH s AS (SELECT doc_id, {q.normalised('text')} AS t, {SPLIT.format(h=q.hash32('CAST(doc_id AS VARCHAR)') + ' % 1000')} AS split FROM documents)"
    " SELECT doc_id FROM s WHERE split = 'train' AND t IN (SELECT t FROM s WHERE split = 'canary_never_train')",
    [],
    ["D5"],
)
def split_leakage(spark, sf_dir):
    # Splitting by id instead of text is the mistake this finds.
    docs = v.table(spark, sf_dir, "documents").withColumn(
        "split", datasets.split_of(F.col("doc_id").cast("string"), datasets.DOMAIN_SPLITS)
    )
    return datasets.leaked(docs, F.col("text")).select("doc_id")


@query(
    "quota_split",
    f"SELECT doc_id, lang, CASE WHEN n * 1000 <= c * 700 THEN 'train' WHEN n * 1000 <= c * 900 THEN 'eval_holdout' ELSE 'canary_never_train' END AS split"
    f" FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {q.hash32('CAST(doc_id AS VARCHAR)')}, doc_id) AS n,"
    " count(*) OVER (PARTITION BY lang) AS c FROM documents) x",
    [],
    ["D5"],
)
def quota_split(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return datasets.quota_split(docs, "lang", F.col("doc_id").cast("string"), "doc_id", datasets.DOMAIN_SPLITS)


@query(
    "source_mix",
    "SELECT doc_id, source, rank FROM (SELECT doc_id, source, t, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS rank FROM"
    f" (SELECT doc_id, CASE lang WHEN 'en' THEN 'synthetic' WHEN 'fr' THEN 'curated' ELSE 'adversarial' END AS source, {q.hash32('CAST(doc_id AS VARCHAR)')} AS h,"
    " (SELECT count(*) FROM documents) // 2 AS t FROM documents) y) x"
    " WHERE rank <= CASE source WHEN 'synthetic' THEN t * 600 // 1000 WHEN 'curated' THEN t * 300 // 1000 ELSE t * 100 // 1000 END",
    [],
    ["D6"],
)
def source_mix(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents")
    tagged = docs.select(
        "doc_id", F.expr("CASE lang WHEN 'en' THEN 'synthetic' WHEN 'fr' THEN 'curated' ELSE 'adversarial' END").alias("source")
    )
    total = docs.select(F.expr("count(1) div 2")).scalar()
    return datasets.source_mix(tagged, "source", F.col("doc_id").cast("string"), "doc_id", total)


TOKENS_SQL = "len(regexp_extract_all(text, '\\p{L}+|\\p{N}{1,3}|[^\\s\\p{L}\\p{N}]+'))"


@query(
    "schema_violations",
    f"WITH p AS (SELECT CASE WHEN doc_id % 50 = 0 THEN 'd-same' ELSE 'd-' || doc_id END AS prompt_id, doc_id, {TOKENS_SQL} AS tokens,"
    " n_chars // 4 AS target, CASE WHEN doc_id % 13 = 0 THEN 'short' WHEN n_chars // 4 <= 75 THEN 'short' WHEN n_chars // 4 <= 300 THEN 'medium' ELSE 'long' END AS bucket,"
    " trim(text) = '' AS empty FROM documents), d AS (SELECT *, count(*) OVER (PARTITION BY prompt_id) AS c FROM p)"
    " SELECT doc_id, concat_ws(',', CASE WHEN empty THEN 'prompt_missing' END, CASE WHEN c > 1 THEN 'duplicate_prompt_id' END,"
    " CASE WHEN tokens < 10 OR tokens > 500 THEN 'token_range' END, CASE WHEN bucket <> CASE WHEN target <= 75 THEN 'short' WHEN target <= 300"
    " THEN 'medium' ELSE 'long' END THEN 'bucket_mismatch' END) AS violated FROM d",
    [],
    ["D9"],
)
def schema_violations(spark, sf_dir):
    p = v.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.expr("CASE WHEN doc_id % 50 = 0 THEN 'd-same' ELSE 'd-' || doc_id END").alias("prompt_id"),
        F.col("text").alias("prompt"),
        F.expr("n_chars div 4").alias("target_output_tokens"),
        F.when(F.col("doc_id") % 13 == 0, "short").otherwise(datasets.assign_bucket(F.expr("n_chars div 4"))).alias("bucket"),
    )
    out = datasets.violations(p, approx_tokens(F.col("prompt")))
    return out.select("doc_id", F.array_join("violated", ",").alias("violated"))


@query(
    "bucket_mix",
    f"WITH {DOC_PROMPTS}, c AS (SELECT dataset_id, bucket, count(*) AS prompts FROM doc_prompts GROUP BY ALL)"
    " SELECT dataset_id, bucket, prompts, prompts::DOUBLE / sum(prompts) OVER (PARTITION BY dataset_id) AS share,"
    " CASE bucket WHEN 'long' THEN 0.2 ELSE 0.4 END::DOUBLE AS target_share FROM c",
    [],
    ["A12"],
)
def bucket_mix(spark, sf_dir):
    return datasets.bucket_mix(normalised_prompts(spark, sf_dir), ["dataset_id"])


@query("dataset_ids", "SELECT DISTINCT source AS dataset_id FROM documents", [], ["A13"])
def dataset_ids(spark, sf_dir):
    return normalised_prompts(spark, sf_dir).select("dataset_id").distinct()


@query(
    "prompt_length_stats",
    f"SELECT s.scenario_id, prompts, min_tokens, max_tokens, out_of_range, p50_tokens, p95_tokens FROM (SELECT lang AS scenario_id, count(*) AS prompts,"
    " min(n) AS min_tokens, max(n) AS max_tokens, CAST(sum(CASE WHEN n BETWEEN 10 AND 500 THEN 0 ELSE 1 END) AS BIGINT) AS out_of_range"
    f" FROM (SELECT lang, {TOKENS_SQL} AS n FROM documents) x GROUP BY lang) s JOIN ("
    + q.percentiles("documents", "lang", TOKENS_SQL, {"p50_tokens": 500, "p95_tokens": 950}, 1)
    + ") p ON p.lang = s.scenario_id",
    [],
    ["A23"],
)
def prompt_length_stats(spark, sf_dir):
    stats = datasets.length_stats(normalised_prompts(spark, sf_dir), ["scenario_id"], approx_tokens(F.col("prompt")))
    return stats


@query(
    "run_cardinality",
    "SELECT day, count(DISTINCT run_id) AS distinct_ids, count(DISTINCT run_id) >= 20 AS over_limit FROM results GROUP BY day",
    ["results"],
    ["A22"],
)
def run_cardinality(spark, sf_dir):
    return datasets.cardinality_guard(v.results(spark, sf_dir), ["day"], "run_id", 20)


@query(
    "sketched_run_guard",
    "SELECT run_id, CASE WHEN n >= 80 THEN n END AS distinct_ids, n >= 80 AS over_limit FROM (SELECT run_id, count(DISTINCT prompt_id) AS n FROM results GROUP BY run_id) x",
    ["results"],
    ["A22"],
)
def sketched_run_guard(spark, sf_dir):
    """Runs over 80 distinct prompts: sketches stored by day name them, only their rows are counted."""
    r = v.results(spark, sf_dir)
    path = folder(spark, "prompt-sketches")
    sketches.write_by_day(sketches.daily_distinct(r, ["run_id"], "prompt_id"), path)
    found = sketches.sketched_guard(r, spark.read.parquet(path), ["run_id"], "prompt_id", 80)
    exact = F.when(F.col("over_limit"), F.col("distinct_ids"))
    return found.select("run_id", exact.alias("distinct_ids"), "over_limit")


def _digest_sql(levels: int = 4) -> str:
    level = "SELECT source, doc_id AS pos, sha256(concat_ws(chr(1), doc_id, text)) AS d FROM documents"
    for _ in range(levels):
        level = (
            f"SELECT source, pos // 4096 AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM ({level}) l GROUP BY source, pos // 4096"
        )
    return f"SELECT source AS dataset_id, d AS content_digest FROM ({level}) x"


def set_digest(prompts):
    content = F.concat_ws("\x01", F.col("line_no").cast("string"), F.col("prompt"))
    return datasets.content_digest(prompts, ["dataset_id"], "line_no", content)


@query("content_digests", _digest_sql(), [], ["A11", "D10"])
def content_digests(spark, sf_dir):
    return set_digest(normalised_prompts(spark, sf_dir))


@query(
    "promptset_manifests",
    f"WITH g AS ({_digest_sql()}) SELECT source || '-20260301' AS promptset_id, lang AS scenario_id, source AS dataset_id,"
    " '2026-03-01T23:19:38.653930Z' AS created_at, count(*) AS prompt_count, any_value(content_digest) AS checksum, '1.0.0' AS version"
    " FROM documents d JOIN g ON g.dataset_id = d.source GROUP BY lang, source",
    [],
    ["A10", "D10"],
)
def promptset_manifests(spark, sf_dir):
    prompts = normalised_prompts(spark, sf_dir)
    digests = prompts.select("scenario_id", "dataset_id").distinct().join(set_digest(prompts), "dataset_id")
    out = datasets.manifest(prompts, created(), checksum=digests.withColumnRenamed("content_digest", "checksum"))
    return out.select("promptset_id", "scenario_id", "dataset_id", "created_at", "prompt_count", "checksum", "version")


def created():
    return F.lit("2026-03-01 23:19:38.653930").cast("timestamp")


# ---- written and read back ---------------------------------------------------------------------


def folder(spark, name: str) -> str:
    """A new folder for this run below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "promptset_files",
    f"WITH {DOC_PROMPTS} SELECT prompt_id, line_no, bucket, target AS target_output_tokens, sha256(prompt) AS prompt_digest FROM doc_prompts",
    [],
    ["S5"],
)
def promptset_files(spark, sf_dir):
    prompts = normalised_prompts(spark, sf_dir)
    path = folder(spark, "promptset")
    promptsets.write_promptset(prompts, datasets.manifest(prompts, created()), path)
    back = promptsets.read_written_promptset(spark, path)
    return back.select("prompt_id", "line_no", "bucket", "target_output_tokens", F.sha2("prompt", 256).alias("prompt_digest"))


@query(
    "promptset_preview",
    f"WITH {DOC_PROMPTS} SELECT prompt_id, line_no FROM doc_prompts ORDER BY line_no LIMIT 5",
    [],
    ["S3", "K3"],
)
def promptset_preview(spark, sf_dir):
    return promptsets.preview(normalised_prompts(spark, sf_dir)).select("prompt_id", "line_no")


@query(
    "promptset_cap",
    f"WITH {DOC_PROMPTS}, r AS (SELECT dataset_id, line_no, n_rows FROM (SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY line_no) - 1 AS line_no,"
    " length(dataset_id) * 2 AS n_rows FROM doc_prompts) x WHERE line_no < n_rows) SELECT dataset_id, count(*) AS prompts FROM r GROUP BY dataset_id",
    [],
    ["K2"],
)
def promptset_cap(spark, sf_dir):
    prompts = datasets.numbered(
        normalised_prompts(spark, sf_dir), ["dataset_id"], F.floor(F.col("line_no") / datasets.LINES_PER_BLOCK), ["line_no"], "_n"
    ).withColumn("line_no", F.col("_n") - 1)
    kept = promptsets.capped(prompts, F.length("dataset_id") * 2)
    return kept.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("prompts"))


# Suppliers stand for promptset directories, nations for their dataset ids.
MANIFESTS = (
    "m AS (SELECT 'dir-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS directory, 'set-' || s_nationkey AS dataset_id, 'scenario-' || s_nationkey % 7 AS scenario_id,"
    " '1.' || s_suppkey % 12 || '.0' AS version, s_suppkey % 12 AS minor, '2026-03-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') AS created_at,"
    " 'set-' || s_nationkey || '-' || s_suppkey AS promptset_id FROM supplier)"
)


def manifests(spark, sf_dir):
    return v.table(spark, sf_dir, "supplier").select(
        F.expr("'dir-' || lpad(CAST(s_suppkey AS STRING), 6, '0')").alias("directory"),
        F.expr("'set-' || s_nationkey").alias("dataset_id"),
        F.expr("'scenario-' || s_nationkey % 7").alias("scenario_id"),
        F.expr("'1.' || s_suppkey % 12 || '.0'").alias("version"),
        F.expr("'2026-03-' || lpad(CAST(s_suppkey % 28 + 1 AS STRING), 2, '0')").alias("created_at"),
        F.expr("'set-' || s_nationkey || '-' || s_suppkey").alias("promptset_id"),
    )


@query(
    "promptset_resolution",
    f"WITH {MANIFESTS}, r AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'dir-' || lpad(CAST(c_custkey % 500 AS VARCHAR), 6, '0')"
    " WHEN 1 THEN 'set-' || c_nationkey ELSE 'set-x' || c_nationkey END AS name FROM customer)"
    " SELECT c_custkey, r.name, coalesce(d.directory, s.directory) AS directory FROM r LEFT JOIN m d ON d.directory = r.name"
    " LEFT JOIN (SELECT dataset_id, min(directory) AS directory FROM m GROUP BY dataset_id) s ON s.dataset_id = r.name",
    [],
    ["S4"],
)
def promptset_resolution(spark, sf_dir):
    asked = v.table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.expr(
            "CASE c_custkey % 3 WHEN 0 THEN 'dir-' || lpad(CAST(c_custkey % 500 AS STRING), 6, '0')"
            " WHEN 1 THEN 'set-' || c_nationkey ELSE 'set-x' || c_nationkey END"
        ).alias("name"),
    )
    return promptsets.resolve(asked, manifests(spark, sf_dir)).select("c_custkey", "name", "directory")


@query(
    "latest_promptset_versions",
    f"WITH {MANIFESTS} SELECT scenario_id, version, promptset_id FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id"
    " ORDER BY minor DESC, created_at DESC, promptset_id) AS n FROM m) x WHERE n = 1",
    [],
    ["S10", "W6"],
)
def latest_promptset_versions(spark, sf_dir):
    return promptsets.latest_version(manifests(spark, sf_dir)).select("scenario_id", "version", "promptset_id")


@query(
    "manifest_list",
    f"WITH {MANIFESTS} SELECT dataset_id, min(promptset_id) AS promptset_id, count(*) AS prompt_count, '1.0.0' AS version FROM m GROUP BY dataset_id",
    [],
    ["S2"],
)
def manifest_list(spark, sf_dir):
    sets = manifests(spark, sf_dir).groupBy("dataset_id").agg(
        F.min("promptset_id").alias("promptset_id"), F.count(F.lit(1)).alias("prompt_count")
    )
    path = folder(spark, "manifests")
    promptsets.write_manifests(sets, F.col("dataset_id"), path)
    return promptsets.list_promptsets(promptsets.read_manifests(spark, path)).select(
        "dataset_id", "promptset_id", "prompt_count", "version"
    )


@query(
    "results_table",
    "SELECT run_date, count(*) AS results, CAST(sum(tokens_generated) AS BIGINT) AS tokens FROM (SELECT 'y' || (day // 365) AS run_date,"
    " tokens_generated FROM results) r GROUP BY run_date",
    ["results"],
    ["S6"],
)
def results_table(spark, sf_dir):
    path = folder(spark, "results")
    r = v.results(spark, sf_dir).withColumn("run_id", F.concat(F.lit("group-"), F.col("run_no") % 10))
    sinks.write_results(r, path, F.expr("'y' || (day div 365)"))
    back = spark.read.parquet(path)
    return back.groupBy("run_date").agg(
        F.count(F.lit(1)).alias("results"), F.sum("tokens_generated").alias("tokens")
    )


# documents as plain promptset files, one per 4096 documents; a prompt is a document's digest, so that lines are alike
# in both dialects.
SET_LINES = 4096
PLAIN_LINE = "concat('{\"prompt_id\":\"d-', doc_id, '\",\"scenario_id\":\"', coalesce(lang, 'none'), '\",\"prompt\":\"', %s, '\"}')"


def plain_promptsets(spark, sf_dir, path: str):
    """Files of JSON lines in the order of doc_id, as a generator writes them, and their lines."""
    lines = v.table(spark, sf_dir, "documents").selectExpr(
        f"doc_id div {SET_LINES} AS set_no", "doc_id", PLAIN_LINE % "sha2(text, 256)" + " AS line"
    )
    dealt = lines.repartition("set_no").sortWithinPartitions("set_no", "doc_id")
    dealt.select("set_no", "line").write.partitionBy("set_no").text(path)
    return lines


@query(
    "promptset_lines",
    f"SELECT prompt_id, scenario_id, digest, row_number() OVER (PARTITION BY set_no ORDER BY doc_id) - 1 AS line_no FROM (SELECT doc_id, doc_id // {SET_LINES} AS set_no,"
    " 'd-' || doc_id AS prompt_id, coalesce(lang, 'none') AS scenario_id, sha256(text) AS digest FROM documents) d",
    [],
    ["S1"],
)
def promptset_lines(spark, sf_dir):
    """Plain files of several splits each, numbered line by line within their file."""
    path = folder(spark, "plain")
    plain_promptsets(spark, sf_dir, path)
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "64k")
    try:
        read = promptsets.read_promptset(spark, f"{path}/*/*.txt").select("prompt_id", "scenario_id", F.col("prompt").alias("digest"), "line_no")
        numbered = saved(read, "numbered")
    finally:
        spark.conf.set(setting, before)
    return stored(spark, numbered, read)


@query(
    "promptset_checksums",
    f"SELECT set_no, 'sha256:' || sha256(string_agg(line || chr(10), '' ORDER BY doc_id)) AS checksum, TRUE AS intact FROM"
    f" (SELECT doc_id, doc_id // {SET_LINES} AS set_no, {PLAIN_LINE % 'sha256(text)'} AS line FROM documents) d GROUP BY set_no",
    [],
    ["A11", "S1"],
)
def promptset_checksums(spark, sf_dir):
    """Digests of whole files against what their manifests state, which is made from the prompts."""
    path = folder(spark, "checked")
    lines = plain_promptsets(spark, sf_dir, path)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "line"))), lambda x: x["line"])
    whole = F.concat(F.array_join(ordered, "\n"), F.lit("\n"))
    manifest = lines.groupBy("set_no").agg(F.concat(F.lit("sha256:"), F.sha2(whole, 256)).alias("stated"))
    found = promptsets.file_digests(spark, f"{path}/*/*.txt")
    found = found.select(F.regexp_extract("directory", "set_no=(.*)", 1).cast("bigint").alias("set_no"), "checksum")
    return manifest.join(found, "set_no", "left").select("set_no", "checksum", (F.col("stated") == F.col("checksum")).alias("intact"))


def public_encoder(name: str):
    """An encoder of a public vocabulary file: a text's tokens, special tokens' strings read as text."""

    def make():
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(str(public_tokenizers.path(name)))
        tokenizer.encode_special_tokens = True
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    return make


@query("prompt_token_counts", None, [], ["D8"])
def prompt_token_counts(spark, sf_dir):
    """Prompts over their token budget under a real vocabulary, by source; held against the library in tests."""
    count = token_counter(public_encoder("byte_bpe_50k.json"), BYTE_LEVEL_PART)
    docs = v.table(spark, sf_dir, "documents").select("source", count(F.col("text")).alias("tokens"), approx_tokens(F.col("text")).alias("approx"))
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("prompts"),
        F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("longest"),
        F.sum("approx").alias("approx_tokens"),
        F.count(F.when(F.col("tokens") > datasets.INPUT_MAX, 1)).alias("over_limit"),
    )
