"""Result and signal sinks."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def write_results(results: DataFrame, path: str, run_date: Column) -> None:
    """Results by date and run: a report on a date or run opens only its own files.

    Writing a run again replaces it. Rows are gathered by run first; Spark splits large runs and merges small ones.
    """
    dated = results.withColumn("run_date", run_date).hint("rebalance", "run_date", "run_id")
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date", "run_id").parquet(path)


def signal_sink(signals: DataFrame, path: str, checkpoint: str, kind: str, ts: str = "ts", **trigger) -> StreamingQuery:
    """Append a signal stream by date; each kind has its own table and checkpoint."""
    return (
        signals.withColumn("date", F.to_date(ts))
        .writeStream.format("parquet")
        .option("path", f"{path}/{kind}")
        .option("checkpointLocation", f"{checkpoint}/{kind}")
        .partitionBy("date")
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


# Days for which each kind of signal is kept.
RETENTION_DAYS = {"metrics": 15, "logs": 7, "traces": 2}

# The columns of each kind's own table.
SIGNAL_COLUMNS = {
    "metrics": ("ts", "name", "value", "resource", "attributes"),
    "logs": ("ts", "line", "resource", "attributes"),
    "traces": ("ts", "name", "trace_id", "span_id", "parent_span_id", "end_ts", "resource", "attributes"),
}


def write_kind(batch: DataFrame, path: str, kind: str, batch_id: int) -> None:
    """One kind's rows of a batch, by date and batch: writing a batch again replaces what it wrote before."""
    own = batch.where(F.col("kind") == kind).select(*SIGNAL_COLUMNS[kind], F.to_date("ts").alias("date"), F.lit(batch_id).alias("batch"))
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(f"{path}/{kind}")


def fan_out(
    signals: DataFrame, path: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame] | None = None, **trigger
) -> StreamingQuery:
    """One stream of signals (``kind``, ``ts`` and the columns of each kind) into a table per kind.

    Each batch is enriched and kept once, then written to all tables under its batch id. A stream that is stopped between
    two tables repeats the batch when it starts again, with the same rows and the same id, so no table loses or doubles
    any. Signals of other kinds are left out; those without a time go to the null date.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        whole = (enrich(batch) if enrich else batch).persist()
        try:
            for kind in SIGNAL_COLUMNS:
                write_kind(whole, path, kind, batch_id)
        finally:
            whole.unpersist()

    return (
        signals.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def drop_expired(spark: SparkSession, path: str, now: date, grace_days: int = 1, kept: Mapping[str, int] = RETENTION_DAYS) -> list[str]:
    """Delete the date folders of each kind's table that :func:`retained` no longer shows; the folders deleted.

    For tables of :func:`fan_out`, which keep no list of files that a deletion would contradict. A reader that opened the
    table with :func:`retained` up to ``grace_days`` ago plans none of the dates deleted, so it can still finish.
    """
    gone = []
    for kind, days in kept.items():
        table = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
        files = table.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(table):
            continue
        for entry in files.listStatus(table):
            name, _, day = entry.getPath().getName().partition("=")
            if name == "date" and day[:1].isdigit() and date.fromisoformat(day) < now - timedelta(days=days + grace_days):
                files.delete(entry.getPath(), True)
                gone.append(f"{kind}/{name}={day}")
    return sorted(gone)


def retained(signals: DataFrame, now: Column, days: float, date: str = "date", ts: str = "ts") -> DataFrame:
    """Rows young enough to keep; the date condition prunes partitions, the time one is exact."""
    oldest = (now.cast("timestamp").cast("double") - F.lit(days * 86400.0)).cast("timestamp")
    return signals.where((F.col(date) >= F.to_date(oldest)) & (F.col(ts) >= oldest))
