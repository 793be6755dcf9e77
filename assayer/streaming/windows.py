"""Windowed aggregates, sessions, late data and replays on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

DEFAULT_TRIGGER = {"processingTime": "10 seconds"}
# Fixed value: the age from which signals are rejected.
MAX_AGE_HOURS = 168


def tumbling(stream: DataFrame, labels: Sequence[str], size: str, delay: str, aggs: Sequence[Column], ts: str = "ts") -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, size), *labels).agg(*aggs)


def sliding_totals(
    stream: DataFrame, labels: Sequence[str], size: str, slide: str, delay: str, amount: Column | None = None, ts: str = "ts"
) -> DataFrame:
    """Total per sliding window and labels.

    Rows are first summed per slide, once each; only those sums are copied into the windows that
    overlap. Both aggregates share the watermark.
    """
    value = F.lit(1) if amount is None else amount
    steps = tumbling(stream, labels, slide, delay, [F.sum(value).alias("_part")], ts)
    timed = steps.select(*labels, "_part", F.window_time("window").alias("_ts"))
    return (
        timed.groupBy(F.window("_ts", size, slide), *labels)
        .agg(F.sum("_part").alias("total"))
        .select(*labels, F.col("window.end").alias("window_end"), "total")
    )


def completed_traces(spans: DataFrame, delay: str, idle: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """A trace is complete when nothing of it arrived for the idle time."""
    return (
        spans.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, idle), "trace_id")
        .agg(F.count(F.lit(1)).alias("spans"))
        .select("trace_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "spans")
    )


def once(stream: DataFrame, ids: Sequence[str], delay: str, ts: str = "ts") -> DataFrame:
    """One row per id while replays may arrive; file and topic sources deliver at least once."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(ids))


def logs_joined_traces(logs: DataFrame, traces: DataFrame, delay: str, reach: str) -> DataFrame:
    """Stream-stream join of log lines and trace starts within ``reach`` of each other."""
    left = logs.withWatermark("log_ts", delay)
    right = traces.withWatermark("trace_ts", delay).withColumnRenamed("trace_id", "_trace")
    near = F.expr(f"log_ts >= trace_ts AND log_ts <= trace_ts + INTERVAL {reach}")
    return left.join(right, (F.col("trace_id") == F.col("_trace")) & near).drop("_trace")


def is_late(ts: Column, now: Column, hours: int = MAX_AGE_HOURS) -> Column:
    return ts < now - F.expr(f"INTERVAL {hours} HOURS")


def reject_late(stream: DataFrame, now: Column, accepted: str, rejected: str, checkpoint: str, ts: str = "ts", **trigger) -> StreamingQuery:
    """Accepted rows to one table, a count of rejected ones per batch to another."""

    def write(batch: DataFrame, batch_id: int) -> None:
        late = is_late(F.col(ts), now)
        batch = batch.persist()
        batch.where(~late).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
        batch.where(late).agg(F.count(F.lit(1)).alias("rejected")).write.mode("overwrite").parquet(
            f"{rejected}/batch={batch_id}"
        )
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or DEFAULT_TRIGGER))
        .start()
    )


def to_table(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to a parquet table with exactly-once files."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or DEFAULT_TRIGGER))
        .start()
    )


def updates_to_table(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep every update of a stateful stream, by batch; a rerun of a batch overwrites its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or DEFAULT_TRIGGER))
        .start()
    )
