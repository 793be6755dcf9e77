"""Stored rules evaluated on a stream of counter samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from assayer.streaming.state import counter_gains
from assayer.streaming.windows import DEFAULT_TRIGGER


def windowed_gains(
    samples: DataFrame,
    series: Sequence[str],
    by: Sequence[str],
    window_s: int,
    step_s: int,
    delay: str,
    parts: dict[str, Column | None] | None = None,
) -> DataFrame:
    """Increase by labels at each evaluation time ``eval_t`` from a stream of samples (series, t, value, ts).

    The streamed form of ``metrics.windowed``: gains between neighbouring samples, keyed by series; their sums by labels
    and the steps of their two samples; and the sums of those that lie in [eval_t - window, eval_t) whole. Each is a
    stateful operator of one query; an evaluation time comes out once, when the watermark has passed it.
    """
    if window_s % step_s:
        raise ValueError("the window must be a multiple of the step")
    parts = parts or {"increase": None}
    gains = counter_gains(samples, series, delay, bucket_s=step_s)
    sums = [F.sum(F.col("gain") if c is None else F.when(c, F.col("gain"))).alias(n) for n, c in parts.items()]
    from_step = (F.floor(F.col("from_t") / step_s) * step_s).alias("from_step")
    steps = gains.groupBy(F.window("ts", f"{step_s} seconds"), from_step, *by).agg(*sums)
    timed = steps.select(*by, "from_step", *parts, F.window_time("window").alias("at"))
    spread = timed.withColumn("span", F.window("at", f"{window_s} seconds", f"{step_s} seconds"))
    inside = spread.where(F.col("from_step") >= F.unix_seconds("span.start"))
    out = inside.groupBy("span", *by).agg(*[F.sum(n).alias(n) for n in parts])
    return out.select(*by, F.unix_seconds("span.end").alias("eval_t"), *parts)


def rule_to_table(
    vectors: DataFrame, finish: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Finish each batch of complete evaluation times and keep it under its batch id; a rerun replaces its own.

    All rows of an evaluation time come out in one batch, so ratios and quantiles are taken by the batch operators.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        finish(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        vectors.writeStream.foreachBatch(write)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or DEFAULT_TRIGGER))
        .start()
    )
