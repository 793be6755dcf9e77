from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from assayer.operators import datasets
from assayer.sources import config, promptsets, signals, sinks


def write_set(root, name, rows, **manifest):
    folder = root / name
    folder.mkdir(parents=True)
    text = "".join(json.dumps(r) + "\n" for r in rows)
    (folder / "promptset.jsonl").write_text(text)
    body = {"dataset_id": f"{name}-data", "prompt_count": len(rows), "checksum": "sha256:" + hashlib.sha256(text.encode()).hexdigest(), **manifest}
    (folder / "manifest.json").write_text(json.dumps(body, indent=2))


@pytest.fixture
def root(tmp_path):
    write_set(tmp_path, "b", [{"prompt_id": f"b-{i}", "prompt": f"text {i} " + "x" * 200} for i in range(3000)], version="1.2.0", scenario_id="s")
    write_set(tmp_path, "a", [{"prompt_id": "a-1", "prompt": "é", "expected_contains": ["x"]}], version="1.10.0", scenario_id="s")
    return tmp_path


def test_line_numbers_follow_the_file_however_it_is_split(spark, root):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        assert spark.read.text(f"{root}/b/promptset.jsonl").rdd.getNumPartitions() > 5
        got = promptsets.read_promptset(spark, f"{root}/*/promptset.jsonl")
        rows = got.where("prompt_id LIKE 'b-%'").select("prompt_id", "line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 3000 and all(r.prompt_id == f"b-{r.line_no}" for r in rows)


def test_manifests_preview_and_cap(spark, root):
    listed = promptsets.list_promptsets(promptsets.read_manifests(spark, str(root))).collect()
    assert [(r.directory, r.promptset_id, r.dataset_id, r.prompt_count) for r in listed] == [("a", "a", "a-data", 1), ("b", "b", "b-data", 3000)]
    prompts = promptsets.read_promptset(spark, f"{root}/b/promptset.jsonl")
    assert [r.line_no for r in promptsets.preview(prompts).collect()] == [0, 1, 2, 3, 4]
    assert promptsets.capped(prompts, 7).count() == 7


def test_resolution_and_latest_version(spark, root):
    manifests = promptsets.read_manifests(spark, str(root))
    asked = spark.createDataFrame([("a",), ("b-data",), ("none",)], "name string")
    assert {r.name: r.directory for r in promptsets.resolve(asked, manifests).collect()} == {"a": "a", "b-data": "b", "none": None}
    assert promptsets.latest_version(manifests).first().version == "1.10.0"


def test_file_digests_match_manifests(spark, root):
    check_digests(spark, str(root))


@pytest.mark.skipif("PROMPTSET_ROOT" not in os.environ, reason="PROMPTSET_ROOT names no promptset folder")
def test_file_digests_of_given_promptsets(spark):
    check_digests(spark, os.environ["PROMPTSET_ROOT"])
    prompts = promptsets.read_promptset(spark, f"{os.environ['PROMPTSET_ROOT']}/*/promptset.jsonl")
    target = F.coalesce("target_output_tokens", F.lit(datasets.DEFAULT_TARGET))
    assert prompts.where(F.col("bucket") != datasets.assign_bucket(target)).count() == 0


def check_digests(spark, root):
    stated = promptsets.read_manifests(spark, root).select("directory", F.col("checksum").alias("stated"))
    found = promptsets.file_digests(spark, f"{root}/*/promptset.jsonl").join(stated, "directory").collect()
    assert found and all(r.checksum == r.stated for r in found)


def test_written_sets_read_back_without_loss_or_doubles(spark, tmp_path):
    out = str(tmp_path / "out")
    made = F.lit("2026-03-01 10:00:00").cast("timestamp")

    def write(scenario, version, n):
        rows = spark.createDataFrame([(i, f"p{i}", f"{version} {i}", 80) for i in range(n)], "line_no bigint, prompt_id string, prompt string, target_output_tokens bigint")
        prompts = datasets.normalise_prompts(rows, scenario, "d")
        manifest = datasets.manifest(prompts, made, version=version)
        promptsets.write_promptset(prompts, manifest, out)
        return prompts, manifest

    _, manifest = write("s", "1.0.0", 3)
    assert manifest.first().promptset_id == "d-20260301" and manifest.first().created_at == "2026-03-01T10:00:00.000000Z"
    write("t", "1.0.0", 4)
    write("s", "2.0.0", 5)
    write("s", "1.0.0", 2)  # again, shorter
    back = promptsets.read_written_promptset(spark, out)
    assert sorted((r.scenario_id, r["count"]) for r in back.groupBy("scenario_id").count().collect()) == [("s", 7), ("t", 4)]
    one = promptsets.read_written_promptset(spark, out, "t-d-1.0.0").orderBy("line_no").collect()
    assert [(r.line_no, r.prompt_id, r.bucket) for r in one] == [(i, f"p{i}", "medium") for i in range(4)]
    listed = promptsets.list_promptsets(promptsets.read_manifests(spark, out)).collect()
    assert [(r.directory, r.prompt_count, r.version) for r in listed] == [("s-d-1.0.0", 2, "1.0.0"), ("s-d-2.0.0", 5, "2.0.0"), ("t-d-1.0.0", 4, "1.0.0")]


def test_two_scenarios_of_a_dataset_in_one_write(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", "x", 80)], "line_no bigint, prompt_id string, prompt string, target_output_tokens bigint")
    both = datasets.normalise_prompts(rows, "s", "d").unionByName(datasets.normalise_prompts(rows, "t", "d"))
    promptsets.write_promptset(both, datasets.manifest(both, F.lit("2026-03-01 10:00:00").cast("timestamp")), str(tmp_path / "o"))
    assert promptsets.read_written_promptset(spark, str(tmp_path / "o")).count() == 2


def test_no_cap(spark):
    prompts = spark.range(5).withColumnRenamed("id", "line_no")
    for cap in (None, 0, F.lit(None).cast("int"), F.lit(0)):
        assert promptsets.capped(prompts, cap).count() == 5
    assert promptsets.capped(prompts, F.lit(2)).count() == 2


def test_results_written_again_replace_their_run(spark, tmp_path):
    rows = spark.createDataFrame([("r", i) for i in range(4)] + [("q", 9)], "run_id string, n int")
    for part in (rows, rows.where("run_id = 'r' AND n < 2")):
        sinks.write_results(part, str(tmp_path / "r"), F.lit("d"))
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [0, 1, 9]


def test_config(spark, tmp_path):
    pack = {"domain_id": "law", "team": "t", "splits": {"train": 0.7, "eval_holdout": 0.2, "canary_never_train": 0.1}}
    assert {r.split: r.share for r in config.domain_pack(spark, pack).collect()} == {"train": 700, "eval_holdout": 200, "canary_never_train": 100}
    spec = {"scenario_id": "s", "prompt_templates": [{"template": "{n}", "variables": {"n": ["x", "y"]}, "target_output_tokens": {"x": 5}}]}
    assert sorted((r.value, r.target_output_tokens) for r in config.scenario(spark, spec).collect()) == [("x", 5), ("y", None)]
    (tmp_path / "r.jsonl").write_text('{"eval_id": "e", "expected_scores": {"coherence": 0.8}}\n')
    assert config.read_rubric_set(spark, str(tmp_path)).first().expected_scores == {"coherence": 0.8}


def test_log_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text('{"severity": "ERROR", "service.name": "s", "extra": 1}\nnot json\n')
    rows = signals.read_log_lines(spark, str(tmp_path)).orderBy("line").collect()
    assert rows[1].severity == "ERROR" and rows[1].service_name == "s" and rows[1].fields["extra"] == "1"
    assert rows[0].severity is None
