"""Promptset directories: JSONL prompts and manifests, read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from assayer.schemas import MANIFEST, PROMPT

LINE_NO = T.StructField("line_no", T.LongType())
# A set's folder holds these two as files, or as folders named file=... of what Spark wrote.
PROMPTS_FILE, MANIFEST_FILE = "promptset.jsonl", "manifest.json"


def read_promptset(spark: SparkSession, path: str) -> DataFrame:
    """Prompts of any JSONL files with ``line_no``, counted from 0 per file.

    A split of a file is read in order by one task, so a row's place in its split is its row id
    less the split's smallest; the splits before it are counted in one row per split. No file is
    brought into one task.
    """
    raw = (
        spark.read.schema(PROMPT)
        .json(path)
        .select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_at"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    before = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        raw.groupBy("_file", "_at")
        .agg(F.min("_row").alias("_low"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    return (
        raw.join(splits, ["_file", "_at"])
        .withColumn("line_no", F.col("_row") - F.col("_low") + F.col("_before"))
        .drop("_file", "_at", "_row", "_low", "_n", "_before")
    )


def read_written_promptset(spark: SparkSession, root: str, directory: str | None = None) -> DataFrame:
    """Prompts of one set, or of all, written by :func:`write_promptset`. Lines carry their number: a cap on
    ``line_no`` is a plain filter on the scan."""
    folder = "*" if directory is None else f"directory={directory}"
    return spark.read.schema(T.StructType([*PROMPT.fields, LINE_NO])).json(f"{root}/{folder}/file={PROMPTS_FILE}")


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """All manifests below ``root`` by directory name, with defaults for missing fields."""
    raw = (
        spark.read.option("multiLine", True)
        .schema(MANIFEST)
        .json(f"{root}/*/*{MANIFEST_FILE}")
        .withColumn("directory", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/(?:file=)?manifest\\.json", 1))
        .withColumn("directory", F.regexp_replace("directory", "^directory=", ""))
    )
    return raw.select(
        "directory",
        F.coalesce("promptset_id", "directory").alias("promptset_id"),
        F.coalesce("scenario_id", F.lit("unknown")).alias("scenario_id"),
        F.coalesce("dataset_id", F.lit("unknown")).alias("dataset_id"),
        F.coalesce("prompt_count", F.lit(0)).alias("prompt_count"),
        F.coalesce("created_at", F.lit("")).alias("created_at"),
        F.coalesce("version", F.lit("1.0.0")).alias("version"),
        F.coalesce("checksum", F.lit("")).alias("checksum"),
    )


def list_promptsets(manifests: DataFrame) -> DataFrame:
    return manifests.orderBy("directory")


def preview(prompts: DataFrame, n: int = 5) -> DataFrame:
    return prompts.orderBy("line_no").limit(n)


def resolve(requests: DataFrame, manifests: DataFrame) -> DataFrame:
    """Directory for each asked name: the directory itself, else the smallest directory with that
    dataset id; null when there is neither."""
    by_dir = manifests.select(F.col("directory").alias("name"), F.col("directory").alias("_dir"))
    by_set = manifests.groupBy(F.col("dataset_id").alias("name")).agg(F.min("directory").alias("_set"))
    return (
        requests.join(by_dir, "name", "left")
        .join(by_set, "name", "left")
        .withColumn("directory", F.coalesce("_dir", "_set"))
        .drop("_dir", "_set")
    )


def latest_version(manifests: DataFrame) -> DataFrame:
    """Newest manifest per scenario: by version number parts, then by creation time."""
    parts = F.transform(F.split("version", "\\."), lambda p: p.try_cast("int"))
    newest = Window.partitionBy("scenario_id").orderBy(
        F.col("_parts").desc(), F.col("created_at").desc(), F.col("promptset_id")
    )
    return (
        manifests.withColumn("_parts", parts)
        .withColumn("_n", F.row_number().over(newest))
        .where("_n = 1")
        .drop("_parts", "_n")
    )


def write_promptset(prompts: DataFrame, manifest: DataFrame, root: str) -> None:
    """Prompts with their line numbers, and the manifest, of each set in a folder of its own below ``root``.

    A set is a scenario, a dataset and a version. Only the folders of the sets written are replaced.
    """
    keys = ["scenario_id", "dataset_id"]
    folder = F.concat_ws("-", *keys, "version")
    sets = manifest.select(*keys, folder.alias("directory"))
    _replace(prompts.join(sets, keys), root, PROMPTS_FILE)
    write_manifests(manifest, folder, root)


def write_manifests(manifest: DataFrame, directory: Column, root: str) -> None:
    """Each manifest in its set's folder."""
    _replace(manifest.withColumn("directory", directory), root, MANIFEST_FILE)


def _replace(rows: DataFrame, root: str, file: str) -> None:
    dynamic = rows.withColumn("file", F.lit(file)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    dynamic.partitionBy("directory", "file").json(root)


def file_digests(spark: SparkSession, glob: str) -> DataFrame:
    """SHA-256 of whole files as manifests state it; for single-file sets."""
    return spark.read.format("binaryFile").load(glob).select(
        F.element_at(F.split("path", "/"), -2).alias("directory"),
        F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("checksum"),
    )


def capped(prompts: DataFrame, max_prompts: int | Column | None) -> DataFrame:
    """The first prompts in file order as a filter, which reaches the scan where a limit would not.

    As in the original, null and 0 mean no cap.
    """
    if isinstance(max_prompts, Column):
        return prompts.where(max_prompts.isNull() | (max_prompts == 0) | (F.col("line_no") < max_prompts))
    return prompts.where(F.col("line_no") < max_prompts) if max_prompts else prompts
