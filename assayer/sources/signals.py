"""Spans, metric samples and logs as batches or streams, one explicit schema each."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.schemas import LOG_FIXED, SAMPLE, SPAN

SCHEMAS = {"spans": SPAN, "metrics": SAMPLE}


def read_signals(spark: SparkSession, kind: str, path: str, stream: bool = True, **options: str) -> DataFrame:
    """A file source of spans, metrics (parquet) or logs (text lines)."""
    reader = spark.readStream if stream else spark.read
    for key, value in options.items():
        reader = reader.option(key, value)
    if kind == "logs":
        return reader.text(path).withColumnRenamed("value", "line")
    return reader.schema(SCHEMAS[kind]).parquet(path)


def read_signals_kafka(spark: SparkSession, kind: str, servers: str, topic: str, **options: str) -> DataFrame:
    """The same signals as JSON records of a topic; needs Spark's Kafka package on the cluster."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
        .select(F.col("value").cast("string").alias("line"))
    )
    if kind == "logs":
        return raw
    return raw.select(F.from_json("line", SCHEMAS[kind]).alias("r")).select("r.*")


def read_log_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Log lines with their fixed fields as columns and every key in ``fields``."""
    from assayer.operators.logs import parse_logs

    return parse_logs(read_signals(spark, "logs", path, stream), promoted=LOG_FIXED)


def with_target_labels(samples: DataFrame, targets: Mapping[str, Mapping[str, str]], on: str = "target") -> DataFrame:
    """Static labels of scrape targets; the target list is configuration, built on the driver."""
    names = sorted({n for labels in targets.values() for n in labels})
    rows = [(t, *[labels.get(n, "") for n in names]) for t, labels in targets.items()]
    schema = ", ".join([f"{on} string", *[f"`{n}` string" for n in names]])
    table = samples.sparkSession.createDataFrame(rows, schema)
    return samples.join(table, on, "left").fillna("", subset=names)
