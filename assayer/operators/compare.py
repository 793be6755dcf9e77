"""Variants compared on the same prompts, and the verdicts drawn from that."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.functions.numbers import fold_bool, micros, py_round, ratio
from assayer.functions.quantiles import exact_percentiles

BASELINE_ERROR = "[baseline error]"  # fixed value: what stands for the answer of a failed baseline call


def baseline_per_prompt(results: DataFrame) -> DataFrame:
    """One baseline answer per prompt, the first in file order; with its preview where results have one."""
    said = []
    if {"error", "response_preview"} <= set(results.columns):
        shown = F.when(F.col("error").isNotNull(), F.lit(BASELINE_ERROR)).otherwise(F.col("response_preview"))
        said = [F.min_by(shown, "line_no").alias("baseline_response")]
    return results.groupBy("prompt_id").agg(
        F.min_by("passed", "line_no").alias("baseline_passed"),
        F.min_by("latency_ms", "line_no").alias("baseline_latency_ms"),
        *said,
    )


def with_baseline(candidates: DataFrame, baseline: DataFrame) -> DataFrame:
    """Candidate rows with the baseline of their prompt; AQE may split a hot prompt on the left."""
    return candidates.join(baseline_per_prompt(baseline), "prompt_id", "left")


def baseline_comparison(paired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidate against baseline.

    Reference figures divide by all rows, so a missing baseline counts as failed with latency 0;
    ``*_answered`` figures divide by the rows that have one.
    """
    n = F.col("total")
    sums = paired.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(fold_bool(F.col("passed"))).alias("passed"),
        F.sum(fold_bool(F.col("baseline_passed"))).alias("baseline_passed"),
        F.count("baseline_latency_ms").alias("with_baseline"),
        F.sum(micros(F.col("latency_ms"))).alias("_us"),
        F.sum(micros(F.coalesce(F.col("baseline_latency_ms"), F.lit(0.0)))).alias("_base_us"),
    )
    us, base_us = F.col("_us").cast("double"), F.col("_base_us").cast("double")
    return sums.select(
        *keys,
        "total",
        "passed",
        "baseline_passed",
        "with_baseline",
        py_round(ratio(F.col("baseline_passed"), n) * 100, 1).alias("baseline_pass_rate"),
        py_round(ratio(base_us / 1000.0, n), 1).alias("baseline_avg_latency_ms"),
        ratio(base_us / 1000.0, F.col("with_baseline")).alias("baseline_avg_latency_answered_ms"),
        py_round(ratio(F.col("passed") - F.col("baseline_passed"), n) * 100, 1).alias("delta_pass_rate"),
        py_round(ratio(base_us, us), 2).alias("latency_speedup"),
    )


def variant_table(results: DataFrame, variants: Sequence[str], keys: Sequence[str] = ("prompt_id",)) -> DataFrame:
    """One row per prompt with attempts, passes and latency of each variant side by side.

    A conditional aggregate, not a self join: each input row is read once and combined before
    the shuffle, however often a prompt occurs.
    """
    aggs: list[Column] = []
    for v in variants:
        mine = F.col("variant") == v
        aggs += [
            F.count(F.when(mine, 1)).alias(f"n_{v}"),
            F.sum(fold_bool(mine & F.col("passed"))).alias(f"ok_{v}"),
            F.coalesce(F.sum(F.when(mine, micros(F.col("latency_ms")))), F.lit(0)).alias(f"us_{v}"),
        ]
    return results.where(F.col("variant").isin(*variants)).groupBy(*keys).agg(*aggs)


def variant_pairs(table: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = ("prompt_id",)) -> DataFrame:
    """Rows (prompt, a, b) for each configured pair both of whose sides answered."""
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"),
                F.lit(b).alias("b"),
                *[F.col(f"{what}_{v}").alias(f"{what}_{side}") for side, v in (("a", a), ("b", b)) for what in ("n", "ok", "us")],
            )
            for a, b in pairs
        ]
    )
    wide = table.select(*keys, F.inline(entries))
    return wide.where((F.col("n_a") > 0) & (F.col("n_b") > 0))


def _outcome() -> Column:
    """Whether b beats a: all attempts passed first, then the share passed (cross-multiplied)."""
    all_a, all_b = F.col("ok_a") == F.col("n_a"), F.col("ok_b") == F.col("n_b")
    left, right = F.col("ok_b") * F.col("n_a"), F.col("ok_a") * F.col("n_b")
    return (
        F.when(all_b & ~all_a, 1)
        .when(all_a & ~all_b, -1)
        .otherwise(F.signum((left - right).cast("double")).cast("int"))
    )


def ab_win_rate(pairs: DataFrame, max_regressions: float = 0.05) -> DataFrame:
    """Wins, ties and losses of b against a; flagged when too many prompts a passed fail on b."""
    scored = pairs.withColumn("_o", _outcome()).withColumn(
        "_reg", (F.col("ok_a") == F.col("n_a")) & (F.col("ok_b") < F.col("n_b"))
    )
    n = F.col("prompts")
    return (
        scored.groupBy("a", "b")
        .agg(
            F.count(F.lit(1)).alias("prompts"),
            F.count(F.when(F.col("_o") > 0, 1)).alias("wins"),
            F.count(F.when(F.col("_o") == 0, 1)).alias("ties"),
            F.count(F.when(F.col("_o") < 0, 1)).alias("losses"),
            F.sum(fold_bool(F.col("_reg"))).alias("regressions"),
        )
        .withColumn("win_rate", ratio(F.col("wins"), n))
        .withColumn("regressed", ratio(F.col("regressions"), n) > max_regressions)
    )


def paired_deltas(pairs: DataFrame) -> DataFrame:
    """Mean latency and pass share of both sides over the shared prompts."""
    return pairs.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("prompts"),
        ratio(F.sum("ok_a"), F.sum("n_a")).alias("pass_share_a"),
        ratio(F.sum("ok_b"), F.sum("n_b")).alias("pass_share_b"),
        ratio(F.sum("us_a") / 1000.0, F.sum("n_a")).alias("avg_latency_a_ms"),
        ratio(F.sum("us_b") / 1000.0, F.sum("n_b")).alias("avg_latency_b_ms"),
    )


def quality_delta(results: DataFrame, baseline: str, category: Column) -> DataFrame:
    """Pass rate of each variant minus that of the baseline, per category."""
    rates = results.groupBy(category.alias("category"), "variant").agg(
        F.count(F.lit(1)).alias("total"), F.sum(fold_bool(F.col("passed"))).alias("passed")
    )
    per = Window.partitionBy("category")
    base = F.max(F.when(F.col("variant") == baseline, ratio(F.col("passed"), F.col("total")))).over(per)
    return rates.select(
        "category",
        "variant",
        "total",
        "passed",
        ratio(F.col("passed"), F.col("total")).alias("pass_share"),
        (ratio(F.col("passed"), F.col("total")) - base).alias("delta"),
    )


def weighted_score(results: DataFrame, weights: Mapping[str, float], category: Column, keys: Sequence[str]) -> DataFrame:
    """Sum of weights passed over sum of weights; a category without weight counts 1.

    Weights are taken in whole thousandths, so that the sums are exact.
    """
    w = F.lit(1000).cast("bigint")
    for name, value in weights.items():
        w = F.when(category == name, F.lit(round(value * 1000)).cast("bigint")).otherwise(w)
    return results.groupBy(*keys).agg(
        ratio(F.sum(w * fold_bool(F.col("passed"))), F.sum(w)).alias("weighted_score"),
        F.count(F.lit(1)).alias("total"),
    )


def pareto_front(points: DataFrame, group: Sequence[str], quality: str, cost: str) -> DataFrame:
    """Marks points no other point of the group beats on quality (high) and cost (low).

    ``points`` is aggregated and ``cost`` a whole number. Sorted by cost, a point is on the front
    when nothing cheaper is as good and nothing equally dear is better: two running maxima.
    """
    w = Window.partitionBy(*group).orderBy(cost)
    cheaper = F.max(quality).over(w.rangeBetween(Window.unboundedPreceding, -1))
    upto = F.max(quality).over(w.rangeBetween(Window.unboundedPreceding, 0))
    on_front = (F.col(quality) == upto) & (cheaper.isNull() | (cheaper < F.col(quality)))
    return points.withColumn("on_front", on_front)


def latency_percentiles(results: DataFrame, keys: Sequence[str], points: dict[str, int]) -> DataFrame:
    """Percentiles (in thousandths) in ms, exact on whole microseconds."""
    us = results.select(*keys, micros(F.col("latency_ms")).alias("_us"))
    out = exact_percentiles(us, keys, "_us", points)
    return out.select(*keys, *[(F.col(p) / 1000.0).alias(p) for p in points])


def canary_gate(summary: DataFrame, min_pass_rate: float = 99.5, max_p95_ms: float = 2000.0) -> DataFrame:
    """Pass rate strictly above and p95 strictly below their limits."""
    return summary.withColumn(
        "gate_passed", (F.col("pass_share") * 100 > min_pass_rate) & (F.col("p95") < max_p95_ms)
    )


def promotion_gate(results: DataFrame, keys: Sequence[str], min_pass_rate: float) -> DataFrame:
    """Verdict on the held-out canary rows of each candidate."""
    held = results.where(F.col("split") == "canary_never_train")
    return held.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.sum(fold_bool(F.col("passed"))).alias("passed")
    ).withColumn(
        "decision",
        F.when(ratio(F.col("passed"), F.col("total")) * 100 >= min_pass_rate, "promote").otherwise("block"),
    )


def kpi_verdicts(figures: DataFrame, rules: DataFrame) -> DataFrame:
    """Figures (kpi, value) against rules (kpi, low, high, strict upper bound, meaning)."""
    value = F.col("value")
    ok = (F.col("low").isNull() | (value >= F.col("low"))) & (
        F.col("high").isNull()
        | F.when(F.col("high_open"), value < F.col("high")).otherwise(value <= F.col("high"))
    )
    return figures.join(rules, "kpi").withColumn("ok", ok)
