"""Runs: expected calls joined to answers, summaries, breakdowns and benchmark roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.functions.numbers import fold_bool, micros, py_round, ratio, whole
from assayer.sources.promptsets import capped

MAX_ERRORS = 20
UNCATEGORIZED = "uncategorized"
# The states in which a run ends.
FINISHED = ("completed", "failed")


def expected_calls(runs: DataFrame, prompts: DataFrame, max_prompts: Column | None = None) -> DataFrame:
    """One row per call a run has to make: its promptset's prompts, up to its cap in file order; null or 0 is no cap."""
    return capped(runs.join(prompts, "promptset"), max_prompts)


def join_responses(calls: DataFrame, responses: DataFrame) -> DataFrame:
    """Calls with their answers; (run, prompt) is unique on both sides, so no key can be hot."""
    answers = responses.withColumn("_answered", F.lit(True))
    joined = calls.join(answers, ["run_id", "prompt_id"], "left")
    return joined.withColumn(
        "error", F.when(F.col("_answered").isNull(), "no response").otherwise(F.col("error"))
    ).drop("_answered")


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.sum(fold_bool(F.col("passed"))).alias("passed"),
        F.sum(micros(F.coalesce(F.col("latency_ms"), F.lit(0.0)))).alias("_latency_us"),
        F.sum(whole(F.col("tokens_per_second") * 10)).alias("_tps_tenths"),
    ]


def _resum() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("total", "passed", "_latency_us", "_tps_tenths")]


def _report(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    total = F.col("total")
    zero = F.lit(0.0)
    return sums.select(
        *keys,
        "total",
        "passed",
        (total - F.col("passed")).alias("failed"),
        F.coalesce(py_round(ratio(F.col("passed"), total) * 100, 1), zero).alias("pass_rate"),
        F.coalesce(py_round(ratio(F.col("_latency_us") / 1000.0, total), 1), zero).alias("avg_latency_ms"),
        F.coalesce(py_round(ratio(F.col("_tps_tenths") / 10.0, total), 1), zero).alias(
            "avg_tokens_per_second"
        ),
    )


def category_of(results: DataFrame) -> Column:
    return F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(UNCATEGORIZED))


def run_summary(results: DataFrame, keys: Sequence[str] = ("run_id",), runs: DataFrame | None = None) -> DataFrame:
    """Totals, pass rate, mean latency and mean tokens/s; failed calls count in every mean.

    With ``runs``, a run that has no result at all appears with zeros.
    """
    sums = results.groupBy(*keys).agg(*_sums())
    if runs is not None:
        sums = runs.select(*keys).join(sums, list(keys), "left").fillna(0)
    return _report(sums, keys)


def category_breakdown(results: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Total and passed per category, in name order when collected."""
    return (
        results.groupBy(*keys, category_of(results).alias("category"))
        .agg(F.count(F.lit(1)).alias("total"), F.sum(fold_bool(F.col("passed"))).alias("passed"))
    )


def breakdown_map(breakdown: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """The breakdown as one map per run; the input is already one row per category."""
    entry = F.struct(F.col("category").alias("key"), F.struct("total", "passed").alias("value"))
    return breakdown.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("category_breakdown")
    )


def run_and_category_summary(results: DataFrame) -> DataFrame:
    """Both levels from one scan: categories first, runs from those rows (category null)."""
    by_category = results.groupBy("run_id", category_of(results).alias("category")).agg(*_sums())
    levels = by_category.groupingSets(
        [["run_id"], ["run_id", "category"]], "run_id", "category"
    ).agg(F.grouping("category").cast("bigint").alias("is_run_total"), *_resum())
    return _report(levels, ["run_id", "category", "is_run_total"])


def error_list(results: DataFrame, limit: int = MAX_ERRORS) -> DataFrame:
    """The first errors of each run in file order; the limit is applied before the shuffle."""
    first = Window.partitionBy("run_id").orderBy("line_no")
    return (
        results.where(F.nullif(F.col("error"), F.lit("")).isNotNull())
        .select("run_id", "line_no", F.concat_ws(": ", "prompt_id", "error").alias("entry"))
        .withColumn("position", F.row_number().over(first))
        .where(F.col("position") <= limit)
    )


def errors_array(errors: DataFrame) -> DataFrame:
    """At most ``MAX_ERRORS`` entries per run as one array."""
    return errors.groupBy("run_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda e: e["entry"]
        ).alias("errors")
    )


def recent_runs(summaries: DataFrame, n: int = 50) -> DataFrame:
    return summaries.orderBy(F.col("started_at").desc(), "run_id").limit(n)


def latest_status(changes: DataFrame) -> DataFrame:
    """Newest status per run from its change log, and how many calls its changes finish together.

    Of changes with one number, those that end the run come last, then the greatest status does.
    """
    newest = F.max(F.struct("seq", F.col("status").isin(*FINISHED).alias("ended"), "status"))
    return (
        changes.groupBy("run_id")
        .agg(newest.alias("n"), F.sum("done").alias("done"))
        .select("run_id", F.col("n.status").alias("status"), F.col("n.seq").alias("seq"), "done")
    )


def newest_state(states: DataFrame) -> DataFrame:
    """The last of the states (run_id, seq, status, done, expired) that a stream has put out for each run."""
    last = F.max_by(F.struct("seq", "status", "done", "expired"), F.struct("done", "seq", "expired"))
    return states.groupBy("run_id").agg(last.alias("s")).select("run_id", "s.*")


def benchmark_summary(results: DataFrame, team_runs: DataFrame) -> DataFrame:
    """Roll-up per benchmark and team; ``team_runs`` has one row per run of a benchmark."""
    return run_summary(results.join(team_runs, "run_id"), ["benchmark_id", "team"])


def benchmark_status(team_status: DataFrame) -> DataFrame:
    """Failed only when every team failed; a skipped team is not a failed one."""
    return team_status.groupBy("benchmark_id").agg(
        F.when(F.bool_and(F.col("status") == "failed"), "failed").otherwise("completed").alias("status"),
        F.count(F.lit(1)).alias("teams"),
        F.sum(fold_bool(F.col("status") == "skipped")).alias("skipped"),
    )


def before_after(summaries: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Each run against the one before it of the same keys, on already aggregated rows."""
    w = Window.partitionBy(*keys).orderBy(order, "run_id")
    for name in ("pass_rate", "avg_latency_ms"):
        summaries = summaries.withColumn(f"previous_{name}", F.lag(name).over(w))
    return summaries.withColumn(
        "pass_rate_change", F.col("pass_rate") - F.col("previous_pass_rate")
    ).withColumn("latency_change_ms", F.col("avg_latency_ms") - F.col("previous_avg_latency_ms"))
