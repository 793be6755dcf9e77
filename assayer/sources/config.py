"""Small configuration: domain packs and scenario templates."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def load_yaml(path: str) -> dict[str, Any]:
    try:
        import yaml
    except ImportError as exc:
        raise RuntimeError("reading YAML needs the yaml package; pass the parsed mapping instead") from exc
    with open(path) as f:
        return yaml.safe_load(f)


def domain_pack(spark: SparkSession, pack: Mapping[str, Any] | str) -> DataFrame:
    """One row per split of a domain, shares in thousandths; from a parsed pack or a YAML file's path."""
    pack = load_yaml(pack) if isinstance(pack, str) else pack
    rows = [
        (pack["domain_id"], pack.get("team", "unknown"), name, round(share * 1000))
        for name, share in pack["splits"].items()
    ]
    return spark.createDataFrame(rows, "domain_id string, team string, split string, share int")


def scenario(spark: SparkSession, spec: Mapping[str, Any] | str) -> DataFrame:
    """One row per template and variable value, with its target length where given; from a parsed
    scenario or a YAML file's path."""
    spec = load_yaml(spec) if isinstance(spec, str) else spec
    rows = []
    for template in spec["prompt_templates"]:
        targets = template.get("target_output_tokens", {})
        for variable, values in template["variables"].items():
            rows += [(spec["scenario_id"], template["template"], variable, v, targets.get(v)) for v in values]
    return spark.createDataFrame(
        rows, "scenario_id string, template string, variable string, value string, target_output_tokens bigint"
    )


def read_rubric_set(spark: SparkSession, path: str) -> DataFrame:
    from assayer.schemas import RUBRIC

    return spark.read.schema(RUBRIC).json(path)
