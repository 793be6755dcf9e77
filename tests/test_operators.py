from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from assayer.operators import compare, datasets, judge, model, routing, runs, telemetry, validate

JOINED = (
    "run_id string, prompt_id string, output string, response string, tokens_reported bigint, latency_ms double, error string,"
    " expected_contains array<string>, expected_format string, category string, variant string, scenario_id string,"
    " dataset_id string, model_version string"
)


def joined(spark, **row):
    base = dict(
        run_id="r", prompt_id="p", output=None, response=None, tokens_reported=None, latency_ms=100.0, error=None,
        expected_contains=None, expected_format=None, category="math", variant=None, scenario_id=None, dataset_id=None, model_version=None,
    )
    names = [f.split()[0] for f in JOINED.split(", ")]
    return spark.createDataFrame([tuple({**base, **row}[n] for n in names)], JOINED)


@pytest.mark.parametrize(
    "row, passed",
    [
        (dict(output="", response="Paris"), True),
        (dict(output="Paris", expected_contains=["paris"]), True),
        (dict(output="Paris", expected_contains=["paris", "rome"]), False),
        (dict(output='{"a":1}', expected_format="json"), True),
        (dict(output='{"a":1} trailing', expected_format="json"), False),
        (dict(output="anything", error="HTTP 500"), False),
    ],
)
def test_validation(spark, row, passed):
    out = validate.to_results(joined(spark, **row), F.lit("quant")).first()
    assert out.passed is passed
    assert (out.variant, out.scenario_id, out.dataset_id) == ("default", "unknown", "unknown")


def test_strict_reference_mode(spark):
    j = joined(spark, output='{"a":1}', expected_format="json")
    assert validate.to_results(j, F.lit("quant"), strict_reference=True).first().passed is False
    failed = joined(spark, error="boom")
    assert validate.to_results(failed, F.lit("q"), strict_reference=True).first().category is None
    assert validate.to_results(failed, F.lit("q")).first().category == "math"


def test_error_row_has_no_tokens_but_counts_in_means(spark):
    ok = joined(spark, output="a b c d", latency_ms=2000.0)
    bad = joined(spark, prompt_id="p2", error="boom", latency_ms=1000.0)
    results = validate.to_results(ok.unionByName(bad), F.lit("quant"))
    s = runs.run_summary(results).first()
    assert (s.total, s.passed, s.failed, s.pass_rate, s.avg_latency_ms, s.avg_tokens_per_second) == (2, 1, 1, 50.0, 1500.0, 1.0)


def test_run_without_results_is_zero(spark):
    results = validate.to_results(joined(spark, output="x"), F.lit("q"))
    listed = spark.createDataFrame([("r",), ("empty",)], "run_id string")
    s = {r.run_id: r for r in runs.run_summary(results, runs=listed).collect()}
    assert (s["empty"].total, s["empty"].pass_rate, s["empty"].avg_latency_ms) == (0, 0.0, 0.0)


def test_missing_response_is_an_error_row(spark):
    calls = spark.createDataFrame([("r", "p1"), ("r", "p2")], "run_id string, prompt_id string")
    answers = spark.createDataFrame([("r", "p1", None)], "run_id string, prompt_id string, error string")
    assert {x.prompt_id: x.error for x in runs.join_responses(calls, answers).collect()} == {"p1": None, "p2": "no response"}


def test_benchmark_fails_only_when_all_fail(spark):
    rows = [("a", "failed"), ("a", "skipped"), ("b", "failed"), ("b", "failed")]
    out = runs.benchmark_status(spark.createDataFrame(rows, "benchmark_id string, status string"))
    assert {r.benchmark_id: r.status for r in out.collect()} == {"a": "completed", "b": "failed"}


def test_numeric_answers(spark):
    cases = [("The result is 9,716.", "9716", True), ("about 9717", "9716", False), ("none", "5", False), ("3.0", "3", True)]
    cases += [("x = 1e-05", "0.00001", True), (".5", "0.5", True), ("3-5", "5", True), ("3-5", "-5", False), ("1e-10", "0", False)]
    cases += [("is -7.", "-7", True), ("0.0", "0", True), ("1E3 or so", "1000", True)]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, a string")
    got = [r.v for r in df.select(validate.numerical_accuracy(F.col("t"), F.col("a")).alias("v")).collect()]
    assert got == [c[2] for c in cases]


def test_pareto_front_with_ties(spark):
    rows = [("g", 0.9, 100), ("g", 0.9, 100), ("g", 0.9, 120), ("g", 0.8, 90), ("g", 0.7, 95), ("g", 0.95, 300)]
    out = compare.pareto_front(spark.createDataFrame(rows, "g string, q double, c bigint"), ["g"], "q", "c")
    assert sorted((r.q, r.c) for r in out.where("on_front").collect()) == [(0.8, 90), (0.9, 100), (0.9, 100), (0.95, 300)]


def test_win_rate_on_a_prompt_with_many_attempts(spark):
    rows = [("p", "a", True, 1.0, i) for i in range(50)] + [("p", "b", i > 0, 1.0, i) for i in range(50)] + [("q", "a", True, 1.0, 0)]
    df = spark.createDataFrame(rows, "prompt_id string, variant string, passed boolean, latency_ms double, line_no int")
    out = compare.ab_win_rate(compare.variant_pairs(compare.variant_table(df, ["a", "b"]), [("a", "b")])).first()
    assert (out.prompts, out.wins, out.losses, out.regressions, out.regressed) == (1, 0, 1, 1, True)


# ---- judge -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "raw, scores, reasoning",
    [
        ('{"coherence": 0.7, "helpfulness": 0.7, "factuality": 0.6, "toxicity": 0.1, "reasoning": "fine"}', (0.7, 0.7, 0.6, 0.1), "fine"),
        ('```json\n{"coherence": 0.9, "helpfulness": 0.8, "factuality": 0.7, "toxicity": 0}\n```', (0.9, 0.8, 0.7, 0.0), ""),
        ('{"coherence": 0.9, "helpfulness": 0.8, "fact', (0.9, 0.8, 0.5, 0.5), "Failed to parse judge output"),
        ("no scores here", (0.5, 0.5, 0.5, 0.5), "Failed to parse judge output"),
        ('{"coherence": 1.2.3}', (0.5, 0.5, 0.5, 0.5), "Failed to parse judge output"),
        ('{"coherence": 0.9}', (0.9, 0.5, 0.5, 0.5), ""),
    ],
)
def test_judge_output(spark, raw, scores, reasoning):
    out = judge.parse_judge_output(spark.createDataFrame([(raw,)], "raw string"), "raw").first()
    assert (out.coherence, out.helpfulness, out.factuality, out.toxicity) == scores
    assert out.reasoning == reasoning


def test_gate_is_inclusive_and_defaults_the_profile(spark):
    rows = [(0.7, 0.7, 0.6, 0.1, "daily-gate-v1"), (0.7, 0.7, 0.6, 0.1, "strict-v1"), (0.7, 0.7, 0.6, 0.1, "nonesuch"), (0.7, 0.7, 0.6, 0.11, None)]
    df = spark.createDataFrame(rows, "coherence double, helpfulness double, factuality double, toxicity double, profile string")
    got = [(r.profile, r.toxicity, r.pass_threshold) for r in judge.gate(df).collect()]
    assert sorted(got, key=str) == sorted(
        [("daily-gate-v1", 0.1, True), ("strict-v1", 0.1, False), ("nonesuch", 0.1, True), (None, 0.11, False)], key=str
    )


def test_model_hook_fills_the_token_default(spark):
    calls = spark.createDataFrame([(1, "a", None), (2, "b", 7)], "id bigint, prompt string, max_tokens int")
    out = model.call_model(calls, lambda: lambda b: b[["id", "max_tokens"]], "id bigint, max_tokens int", partitions=2)
    assert sorted(map(tuple, out.collect())) == [(1, 100), (2, 7)]


def test_model_client_gets_batches_of_bounded_size(spark):
    calls = spark.range(3000, numPartitions=1).selectExpr("id", "repeat(concat('ab ', id), 1500) AS prompt")
    client = lambda: lambda b: b[["id"]].assign(size=int(b["prompt"].str.len().sum()))
    rows = model.call_model(calls, client, "id bigint, size bigint").collect()
    assert len(rows) == 3000 and max(r.size for r in rows) < 6_000_000


# ---- routing ---------------------------------------------------------------------------------------

ROUTES = '{"a": {"url": "u", "ab_variants": {"x": {"weight": 3}, "y": {"weight": 1}, "z": {}}}, "b": {"url": "u", "timeout_ms": 5, "ab_variants": {"x": {"weight": 0}}}, "c": {"url": "u"}}'


def test_variant_choice(spark):
    routes = routing.read_routes(spark, ROUTES)
    assert {r.team: r.timeout_ms for r in routes.collect()} == {"a": 30000, "b": 5, "c": 30000}
    reqs = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")), (F.col("id") % 4 + 1).cast("int")).alias("team"))
    once = routing.select_variant(reqs, routes, F.col("id")).collect()
    again = routing.select_variant(reqs.repartition(7), routes, F.col("id")).collect()
    assert {r.id: r.ab_variant for r in once} == {r.id: r.ab_variant for r in again}
    picked = [r.ab_variant for r in once if r.team == "a"]
    assert set(picked) == {"x", "y"} and 0.7 < picked.count("x") / len(picked) < 0.8
    assert {r.ab_variant for r in once if r.team != "a"} == {None}
    assert {r.route_status for r in routing.route_lookup(reqs, routes).where("team = 'd'").collect()} == {404}


def test_health(spark):
    routes = routing.read_routes(spark, '{"quant": {"url": "u"}, "eval": {"url": "u"}}')
    probes = spark.createDataFrame([("quant", 500, 1), ("quant", 200, 2), ("eval", 503, 1)], "team string, http_status int, seq bigint")
    got = {r.team: (r.status, r.ready_pods, r.total_pods) for r in routing.health_status(routes, probes).collect()}
    assert got == {"quant": ("healthy", 1, 1), "eval": ("degraded", 0, 1), "finetune": ("unknown", 0, 0)}


# ---- datasets --------------------------------------------------------------------------------------


def test_buckets_and_scenario_kept(spark):
    df = spark.createDataFrame([("p", "t", "own", 75), ("q", "t", None, None), ("r", "t", "own", 300), ("s", "t", "own", 301)], "prompt_id string, prompt string, scenario_id string, target_output_tokens bigint")
    out = {r.prompt_id: r for r in datasets.normalise_prompts(df, "set", "data").collect()}
    assert [out[k].bucket for k in "pqrs"] == ["short", "short", "medium", "long"]
    assert out["p"].metadata == {"source_scenario": "own"} and out["q"].metadata is None and out["p"].scenario_id == "set"


def test_digest_ignores_partitions_and_notices_changes(spark):
    df = spark.range(9000).select(F.lit("s").alias("set"), F.col("id").alias("line_no"), F.concat(F.lit("t"), "id").alias("c"))
    digest = lambda d: datasets.content_digest(d, ["set"], "line_no", F.col("c")).first().content_digest
    base = digest(df.repartition(1))
    assert digest(df.repartition(7)) == base
    assert digest(df.withColumn("c", F.when(F.col("line_no") == 8500, "x").otherwise(F.col("c")))) != base
    level = [hashlib.sha256(f"t{i}".encode()).hexdigest() for i in range(9000)]
    for _ in range(4):
        level = [hashlib.sha256("".join(level[i : i + 4096]).encode()).hexdigest() for i in range(0, len(level), 4096)]
    assert base == level[0]


def test_splits_are_stable_and_quota_exact(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("d"), F.col("id") % 5)).alias("dom"))
    split = lambda d: {r.id: r.split for r in d.withColumn("split", datasets.split_of(F.col("id").cast("string"), datasets.DOMAIN_SPLITS)).collect()}
    assert split(df) == split(df.repartition(9))
    out = datasets.quota_split(df, "dom", F.col("id").cast("string"), "id", datasets.DOMAIN_SPLITS).where("dom = 'big'")
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 233, "eval_holdout": 67, "canary_never_train": 34}


def test_dedup_keeps_priority_over_many_copies(spark):
    rows = [(2, f"s{i}", "Same  Text") for i in range(500)] + [(1, "c1", "same text"), (1, "c0", " same\ttext "), (2, "x", "other")]
    out = datasets.deduplicate(spark.createDataFrame(rows, "priority int, prompt_id string, prompt string"), "prompt", "priority", "prompt_id")
    assert sorted((r.prompt_id, r.copies) for r in out.collect()) == [("c0", 502), ("x", 1)]


def test_arithmetic_answers_are_right(spark):
    rows = datasets.arithmetic_prompts(spark.range(500), "id").collect()
    for r in rows:
        q, a = r.prompt, int(r.expected_contains[0])
        n = [int(x) for x in __import__("re").findall(r"\d+", q)]
        if " * " in q and "(" not in q:
            assert a == n[0] * n[1]
        elif "^" in q:
            assert a == n[0] ** n[1]
        elif "divided" in q:
            assert a == n[0] // n[1]
        elif "%" in q:
            assert a == n[0] * n[1] // 100
        elif "(" in q:
            assert a == (n[0] + n[1]) * n[2]
        else:
            assert a == n[0] + n[1] and r.max_tokens == 50


# ---- telemetry -------------------------------------------------------------------------------------


def test_redaction_is_one_decision_per_trace(spark):
    df = spark.range(2000).selectExpr("concat('t', id) AS trace_id", "'raw prompt' AS prompt", "'raw answer' AS completion", "CAST(NULL AS STRING) AS prompt_ref", "CAST(NULL AS STRING) AS completion_ref")
    out = telemetry.redact(df)
    assert "prompt" not in out.columns
    sizes = [len(r.events) for r in out.collect()]
    assert set(sizes) == {0, 2} and 5 <= sizes.count(2) <= 40
    kept = out.where(F.size("events") > 0).first().events[0]
    assert kept["attributes"]["genai.prompt.hash"] == hashlib.sha256(b"raw prompt").hexdigest()[:16]
    assert kept["attributes"]["lab.payload.encrypted_ref"] == "not_stored"


def test_genai_metrics_only_with_output(spark):
    df = spark.createDataFrame([(10, 4, 1000.0), (10, 0, 1000.0), (10, None, 1000.0)], "input_tokens bigint, output_tokens bigint, duration_ms double")
    got = [(r.total_tokens, r.tpot_ms, r.tokens_per_sec) for r in telemetry.genai_metrics(df).collect()]
    assert got == [(14, 250, 4.0), (10, None, None), (None, None, None)]


def test_tokens_without_measurable_time_have_speeds(spark):
    df = spark.createDataFrame([(10, 4, 0.0), (10, 0, 0.0), (10, 4, -1.0)], "input_tokens bigint, output_tokens bigint, duration_ms double")
    got = [(r.total_tokens, r.tpot_ms, r.tokens_per_sec) for r in telemetry.genai_metrics(df).collect()]
    assert got == [(14, 0, float("inf")), (10, None, None), (14, None, None)]


def test_empty_category_and_error_count_as_absent(spark):
    rows = [("r", 1, "p1", "", "", True), ("r", 2, "p2", None, None, False), ("r", 3, "p3", "c", "boom", False)]
    df = spark.createDataFrame(rows, "run_id string, line_no int, prompt_id string, category string, error string, passed boolean")
    assert {r.category: r.total for r in runs.category_breakdown(df).collect()} == {"uncategorized": 2, "c": 1}
    assert [r.entry for r in runs.error_list(df).collect()] == ["p3: boom"]


def test_judge_output_has_to_be_an_object(spark):
    df = spark.createDataFrame([("5",), ("[1,2]",), ('{"coherence": 1}',), ('```json\n{"coherence": 0.25}\n```',)], "raw string")
    got = [(r.parsed, r.coherence, r.reasoning) for r in judge.parse_judge_output(df, "raw").collect()]
    assert got == [(False, 0.5, judge.PARSE_NOTE), (False, 0.5, judge.PARSE_NOTE), (True, 1.0, ""), (True, 0.25, "")]


def test_digest_beyond_its_blocks_is_one_row(spark):
    df = spark.range(5000).select(F.lit("s").alias("set"), F.col("id").alias("line_no"), F.col("id").cast("string").alias("c"))
    assert datasets.content_digest(df, ["set"], "line_no", F.col("c"), levels=1).count() == 1


def test_baseline_answers_come_with_their_preview(spark):
    rows = [("p", 1, True, 5.0, None, "yes"), ("p", 2, False, 6.0, None, "no"), ("q", 1, False, 7.0, "HTTP 502", None)]
    df = spark.createDataFrame(rows, "prompt_id string, line_no int, passed boolean, latency_ms double, error string, response_preview string")
    out = {r.prompt_id: tuple(r)[1:] for r in compare.baseline_per_prompt(df).select("prompt_id", "baseline_passed", "baseline_latency_ms", "baseline_response").collect()}
    assert out == {"p": (True, 5.0, "yes"), "q": (False, 7.0, compare.BASELINE_ERROR)}
