"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from assayer.session import shared_dir


# Whole texts reach Python: smaller batches than Spark's 64 MB leave room for what is made of them.
BATCH_BYTES = "16m"


def small_batches(spark: SparkSession, size: str = BATCH_BYTES) -> SparkSession:
    """Bound the memory of Python workers that are sent whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return spark


def saved(df: DataFrame, name: str) -> str:
    """Write a table into the shared folder; the path of it."""
    path = f"{shared_dir(df.sparkSession)}/assayer-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lost executors cost no recomputation beyond it."""
    return df.sparkSession.read.schema(df.schema).parquet(saved(df, name))


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`saved` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
