"""Counters, histograms and gauges: emission from events and evaluation over sliding windows.

Samples are rows (label columns, t, value) with t in whole seconds. Raw samples are shuffled once,
by (series, step): each group is one series over one step and stays small however hot a series is.
What leaves that stage is one row per series and step; reset correction across steps and sliding
windows work on those rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.functions.numbers import metric_div, ratio
from assayer.functions.ordered import running_sum

STEP = "_step"
BREACH_BLOCK = 4096  # steps numbered in one task
TICK_BLOCK = 4096  # ticks summed in one task


def le_text(bound: float) -> str:
    """A bucket bound as label text."""
    return f"{bound:g}"


def step_of(t: Column, step_s: int) -> Column:
    return (F.floor(t / step_s) * step_s).cast("bigint")


# ---- emission ------------------------------------------------------------------------------


def emit_counter(events: DataFrame, labels: Sequence[str], t: Column, tick_s: int, amount: Column | int = 1) -> DataFrame:
    """Increments per series and tick; combined before the shuffle."""
    inc = F.lit(amount) if isinstance(amount, int) else amount
    return events.groupBy(*labels, step_of(t, tick_s).alias("t")).agg(F.sum(inc).cast("bigint").alias("delta"))


def emit_histogram(
    events: DataFrame, labels: Sequence[str], value: Column, bounds: Sequence[float], t: Column, tick_s: int
) -> DataFrame:
    """Per series and tick: one row per bound with the count at or below it (+Inf last).

    The bounds are plain conditional sums, so events are never multiplied by the bounds. ``le`` is
    text as in any label; a DOUBLE key would be normalised anew, and shuffled again, in each stage.
    """
    counts = [F.count(F.when(value <= F.lit(b), 1)).alias(f"_b{i}") for i, b in enumerate(bounds)]
    wide = events.groupBy(*labels, step_of(t, tick_s).alias("t")).agg(*counts, F.count(value).alias("_all"))
    rows = [F.struct(F.lit(le_text(b)).alias("le"), F.col(f"_b{i}").alias("delta")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("delta")))
    return wide.select(*labels, "t", F.inline(F.array(*rows)))


def accumulate(deltas: DataFrame, series: Sequence[str], restart_s: int | None = None) -> DataFrame:
    """Increments to the cumulative form a scrape sees; ``restart_s`` resets the process clock.

    One input row per series and tick, so the window is bounded by the ticks of a process life.
    """
    life = F.floor(F.col("t") / restart_s) if restart_s else F.lit(0)
    w = (
        Window.partitionBy(*series, "_life").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        deltas.withColumn("_life", life)
        .withColumn("value", F.sum("delta").over(w).cast("double"))
        .drop("_life", "delta")
    )


def in_flight(spans: DataFrame, keys: Sequence[str], start_us: str, end_us: str, tick_s: int) -> DataFrame:
    """Requests in flight at the end of each tick and the highest level inside it.

    +1 at start, -1 at end. Levels inside a tick are relative; the level each tick starts from
    comes from the net change of the ticks before it, summed in blocks of ``TICK_BLOCK`` ticks. Keys must not be null.
    """
    moves = spans.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col(start_us).alias("_us"), F.lit(1).alias("_d")),
                F.struct(F.col(end_us).alias("_us"), F.lit(-1).alias("_d")),
            )
        ),
    )
    # Moves at one instant are one net move.
    moves = moves.groupBy(*keys, "_us").agg(F.sum("_d").alias("_d"))
    moves = moves.withColumn("t", F.floor(F.col("_us") / (tick_s * 1_000_000)) * tick_s)
    inside = Window.partitionBy(*keys, "t").orderBy("_us").rowsBetween(Window.unboundedPreceding, 0)
    per_tick = (
        moves.withColumn("_level", F.sum("_d").over(inside))
        .groupBy(*keys, "t")
        .agg(F.sum("_d").alias("_net"), F.max("_level").alias("_peak"))
    )
    block = F.floor(F.col("t") / (tick_s * TICK_BLOCK))
    upto = running_sum(per_tick, keys, block, ["t"], F.col("_net"), "level")
    return upto.select(*keys, "t", "level", (F.col("level") - F.col("_net") + F.col("_peak")).alias("peak"))


# ---- one row per series and step -----------------------------------------------------------


def counter_steps(samples: DataFrame, series: Sequence[str], step_s: int) -> DataFrame:
    """First and last reset-corrected value per series and step.

    At a reset the value before it is added to everything after it. Inside a step that needs the
    previous sample; between steps, the last value of the step before.
    """
    by_step = Window.partitionBy(*series, STEP).orderBy("t")
    prev = F.lag("value").over(by_step)
    inside = (
        samples.withColumn(STEP, step_of(F.col("t"), step_s))
        .withColumn("_drop", F.when(F.col("value") < prev, prev).otherwise(0.0))
        .groupBy(*series, STEP)
        .agg(
            F.min_by("value", "t").alias("_first"),
            F.max_by("value", "t").alias("_last"),
            F.min("t").alias("first_t"),
            F.max("t").alias("last_t"),
            F.count(F.lit(1)).alias("n"),
            F.sum("_drop").alias("_drop"),
        )
    )
    w = Window.partitionBy(*series).orderBy(STEP)
    before = F.lag("_last").over(w)
    edge = F.when(F.col("_first") < before, before).otherwise(0.0)
    staged = inside.withColumn("_edge", edge)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    corr = F.sum(F.col("_edge") + F.col("_drop")).over(upto)
    return staged.withColumn("_corr", corr).select(
        *series,
        STEP,
        (F.col("_first") + F.col("_corr") - F.col("_drop")).alias("first_v"),
        (F.col("_last") + F.col("_corr")).alias("last_v"),
        F.col("_first").alias("first_raw"),
        "first_t",
        "last_t",
        "n",
    )


def gauge_steps(samples: DataFrame, series: Sequence[str], step_s: int) -> DataFrame:
    """Last and highest value per series and step; a plain aggregate, combined before the shuffle."""
    return samples.groupBy(*series, step_of(F.col("t"), step_s).alias(STEP)).agg(
        F.max_by("value", "t").alias("last_v"),
        F.max("t").alias("last_t"),
        F.max("value").alias("max_v"),
        F.count(F.lit(1)).alias("n"),
    )


def _slide(steps: DataFrame, step_s: int, window_s: int) -> DataFrame:
    """Each step row under every evaluation time ``eval_t`` whose window [eval_t - window, eval_t) holds it."""
    if window_s % step_s:
        raise ValueError("the window must be a multiple of the step")
    ends = F.sequence(F.col(STEP) + step_s, F.col(STEP) + window_s, F.lit(step_s))
    return steps.withColumn("eval_t", F.explode(ends))


# ---- range evaluation ------------------------------------------------------------------------


def increments(samples: DataFrame, series: Sequence[str], step_s: int) -> DataFrame:
    """What each series gained between neighbouring samples, by the steps the two samples lie in.

    Rows (series, from_step, to_step, delta). A value below the one before it is a restart from
    zero. A window's increase is the sum of the gains whose two samples both lie inside it, so gains
    add up over series, can be combined by any labels first, and need no running correction.
    """
    by_step = Window.partitionBy(*series, STEP).orderBy("t")
    inside = (
        samples.withColumn(STEP, step_of(F.col("t"), step_s))
        .withColumn("_gain", _gain(F.lag("value").over(by_step), F.col("value")))
        .groupBy(*series, STEP)
        .agg(
            F.min_by("value", "t").alias("_first"),
            F.max_by("value", "t").alias("_last"),
            F.sum("_gain").alias("_inner"),
        )
    )
    w = Window.partitionBy(*series).orderBy(STEP)
    edges = inside.withColumn("_prev", F.lag(STEP).over(w)).withColumn(
        "_edge", _gain(F.lag("_last").over(w), F.col("_first"))
    )
    rows = F.array(
        F.struct(F.col(STEP).alias("from_step"), F.col(STEP).alias("to_step"), F.col("_inner").alias("delta")),
        F.struct(F.col("_prev").alias("from_step"), F.col(STEP).alias("to_step"), F.col("_edge").alias("delta")),
    )
    return edges.select(*series, F.inline(rows)).where(F.col("delta").isNotNull())


def _gain(before: Column, now: Column) -> Column:
    return F.when(before.isNotNull(), F.when(now < before, now).otherwise(now - before))


def windowed(
    gains: DataFrame,
    by: Sequence[str],
    window_s: int,
    step_s: int,
    parts: dict[str, Column | None] | None = None,
    cluster: Sequence[str] | None = None,
) -> DataFrame:
    """Increase by labels at each step; groups without two samples in the window give no row.

    Gains are combined over series per pair of steps before they are spread over the evaluation
    times, so that spreading costs groups, not series. ``parts`` names conditional sums;
    ``cluster`` places rows by fewer labels for a stage that follows.
    """
    if window_s % step_s:
        raise ValueError("the window must be a multiple of the step")
    parts = parts or {"increase": None}
    sums = [
        F.sum(F.col("delta") if cond is None else F.when(cond, F.col("delta"))).alias(name)
        for name, cond in parts.items()
    ]
    last = F.col("from_step") + window_s
    first = F.col("to_step") + step_s
    spread = (
        gains.where(first <= last)
        .groupBy(*by, "from_step", "to_step")
        .agg(*sums)
        .withColumn("eval_t", F.explode(F.sequence(first, last, F.lit(step_s))))
    )
    if cluster is not None:
        spread = spread.repartition(*cluster, "eval_t")
    return spread.groupBy(*by, "eval_t").agg(*[F.sum(name).alias(name) for name in parts])


def increase(samples: DataFrame, series: Sequence[str], by: Sequence[str], window_s: int, step_s: int) -> DataFrame:
    """Reset-corrected increase (last minus first sample), summed by labels."""
    return windowed(increments(samples, series, step_s), by, window_s, step_s)


def extrapolated_increase(samples: DataFrame, series: Sequence[str], window_s: int, step_s: int) -> DataFrame:
    """Increase per series stretched to the window borders the way Prometheus does.

    Up to half the mean sample gap past the outer samples, all the way when the border is nearer
    than 1.1 gaps, never below zero at the start.
    """
    slid = _slide(counter_steps(samples, series, step_s), step_s, window_s)
    out = (
        slid.groupBy(*series, "eval_t")
        .agg(
            F.min_by("first_v", STEP).alias("_f"),
            F.max_by("last_v", STEP).alias("_l"),
            F.min_by("first_raw", STEP).alias("_raw"),
            F.min("first_t").alias("_t0"),
            F.max("last_t").alias("_t1"),
            F.sum("n").alias("_n"),
        )
        .where("_n >= 2")
        .withColumn("increase", F.col("_l") - F.col("_f"))
    )
    span = (F.col("_t1") - F.col("_t0")).cast("double")
    gap = span / (F.col("_n") - 1)
    to_start = (F.col("_t0") - (F.col("eval_t") - window_s)).cast("double")
    to_end = (F.col("eval_t") - F.col("_t1")).cast("double")
    to_zero = F.when(
        (F.col("increase") > 0) & (F.col("_raw") >= 0),
        span * F.col("_raw") / F.when(F.col("increase") != 0, F.col("increase")),
    )
    to_start = F.least(to_start, F.coalesce(to_zero, to_start))
    limit = gap * 1.1
    stretch = (
        span
        + F.when(to_start < limit, to_start).otherwise(gap / 2)
        + F.when(to_end < limit, to_end).otherwise(gap / 2)
    )
    return out.select(*series, "eval_t", (F.col("increase") * (stretch / span)).alias("increase"))


def rate(samples: DataFrame, series: Sequence[str], by: Sequence[str], window_s: int, step_s: int) -> DataFrame:
    """Per-second rate by labels; the division comes after the sum, which stays exact."""
    inc = increase(samples, series, by, window_s, step_s)
    return inc.select(*by, "eval_t", (F.col("increase") / window_s).alias("value"))


def increase_share(
    samples: DataFrame, series: Sequence[str], by: Sequence[str], numerator: Column, window_s: int, step_s: int
) -> DataFrame:
    """Share of the matching series, in one pass; groups without a matching series give no row."""
    both = windowed(
        increments(samples, series, step_s), by, window_s, step_s, {"_n": numerator, "_d": None}
    )
    return both.where(F.col("_n").isNotNull()).select(
        *by, "eval_t", metric_div(F.col("_n"), F.col("_d")).alias("value")
    )


def join_ratio(num: DataFrame, den: DataFrame, by: Sequence[str], scale: float = 1.0) -> DataFrame:
    """Vector matching of two aggregates on their labels and time; unmatched groups drop out."""
    n = num.withColumnRenamed("increase", "_n")
    d = den.withColumnRenamed("increase", "_d")
    return n.join(d, [*by, "eval_t"]).select(*by, "eval_t", (metric_div(F.col("_n"), F.col("_d")) * scale).alias("value"))


def gain_ratio(num: DataFrame, den: DataFrame, by: Sequence[str], window_s: int, step_s: int) -> DataFrame:
    """Increase of one metric over another's, from the :func:`increments` of both, in one pass; unmatched groups drop out."""
    cols = [*by, "from_step", "to_step", "delta"]
    both = num.select(*cols, F.lit(True).alias("_is_num")).union(den.select(*cols, F.lit(False)))
    out = windowed(both, by, window_s, step_s, {"_n": F.col("_is_num"), "_d": ~F.col("_is_num")})
    return _both_known(out, by)


def vector_ratio(num: DataFrame, den: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of one vector over another's by labels, in one aggregate; unmatched groups drop out."""
    cols = [*by, "eval_t", "value"]
    both = num.select(*cols, F.lit(True).alias("_is_num")).union(den.select(*cols, F.lit(False)))
    n, d = (F.sum(F.when(F.col("_is_num") == side, F.col("value"))) for side in (True, False))
    return _both_known(both.groupBy(*by, "eval_t").agg(n.alias("_n"), d.alias("_d")), by)


def _both_known(sides: DataFrame, by: Sequence[str]) -> DataFrame:
    return sides.where("_n IS NOT NULL AND _d IS NOT NULL").select(*by, "eval_t", metric_div(F.col("_n"), F.col("_d")).alias("value"))


def join_difference(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    return (
        left.withColumnRenamed("value", "_l")
        .join(right.withColumnRenamed("value", "_r"), [*by, "eval_t"])
        .select(*by, "eval_t", (F.col("_l") - F.col("_r")).alias("value"))
    )


def bucket_increase(samples: DataFrame, series: Sequence[str], by: Sequence[str], window_s: int, step_s: int) -> DataFrame:
    """Increase of histogram buckets, all bounds of a group in one place."""
    return windowed(increments(samples, series, step_s), [*by, "le"], window_s, step_s, cluster=by)


def histogram_quantile(q: float, buckets: DataFrame, by: Sequence[str], count: str = "increase") -> DataFrame:
    """Quantile from cumulative buckets (by, eval_t, le, count), interpolated inside the bucket.

    A group is its handful of bounds. Counts that fall from one bound to the next are lifted to the
    running maximum. In the +Inf bucket the answer is the highest finite bound; without observations NaN.
    """
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    bound = F.when(F.col("le") == "+Inf", inf).otherwise(F.col("le").try_cast("double"))
    w = Window.partitionBy(*by, "eval_t").orderBy("_le")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = buckets.withColumn("_le", bound).select(
        *by,
        "eval_t",
        F.col("_le"),
        F.max(count).over(upto).alias("_c"),
        F.coalesce(F.max(count).over(before), F.lit(0.0)).alias("_lo_c"),
        F.lag("_le").over(w).alias("_lo"),
        F.max(count).over(all_rows).alias("_total"),
    )
    le, target = F.col("_le"), F.lit(q) * F.col("_total")
    lower = F.coalesce(F.col("_lo"), F.when(le <= 0, le).otherwise(F.lit(0.0)))
    mass = F.col("_c") - F.col("_lo_c")
    inside = lower + (le - lower) * ((target - F.col("_lo_c")) / F.when(mass != 0, mass))
    value = (
        F.when(le == inf, F.coalesce(F.col("_lo"), nan)).when(mass == 0, le).otherwise(inside)
    )
    return c.where(F.col("_c") >= target).groupBy(*by, "eval_t").agg(
        F.when(F.max("_total") > 0, F.min_by(value, "_le")).otherwise(nan).alias("value")
    )


def instant(samples: DataFrame, series: Sequence[str], step_s: int, lookback_s: int = 300) -> DataFrame:
    """Newest value of each series at each step, no older than the lookback.

    A step's last value holds until the next step with a sample, so every output row is made once.
    """
    steps = gauge_steps(samples, series, step_s)
    following = F.lead(STEP).over(Window.partitionBy(*series).orderBy(STEP))
    until = F.least(F.coalesce(following, F.col(STEP) + lookback_s), F.col(STEP) + lookback_s)
    return steps.withColumn("_until", until).select(
        *series, F.explode(F.sequence(F.col(STEP) + step_s, "_until", F.lit(step_s))).alias("eval_t"), F.col("last_v").alias("value")
    )


def max_over_time(samples: DataFrame, series: Sequence[str], window_s: int, step_s: int) -> DataFrame:
    return (
        _slide(gauge_steps(samples, series, step_s), step_s, window_s)
        .groupBy(*series, "eval_t")
        .agg(F.max("max_v").alias("value"))
    )


def aggregate(vector: DataFrame, how: str, by: Sequence[str]) -> DataFrame:
    """sum, avg, max, min or count of a vector by labels."""
    value = F.col("value")
    agg = {
        "sum": F.sum(value),
        "avg": ratio(F.sum(value), F.count(value)),
        "max": F.max(value),
        "min": F.min(value),
        "count": F.count(value).cast("double"),
    }[how]
    return vector.groupBy(*by, "eval_t").agg(agg.alias("value"))


# ---- what is read off a vector -----------------------------------------------------------------


def last_non_null(vector: DataFrame, by: Sequence[str]) -> DataFrame:
    """Newest value of each series over the shown range."""
    return vector.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*by).agg(
        F.max_by("value", "eval_t").alias("value"), F.max("eval_t").alias("eval_t")
    )


def threshold_level(value: Column, steps: Sequence[tuple[float | None, str]]) -> Column:
    """Level of the highest step whose bound is reached; the first step has no bound."""
    level = F.lit(steps[0][1])
    for bound, name in sorted(steps[1:], key=lambda s: s[0]):
        level = F.when(value >= F.lit(float(bound)), F.lit(name)).otherwise(level)
    return level


def breach_episodes(vector: DataFrame, by: Sequence[str], breached: Column, step_s: int) -> DataFrame:
    """Runs of consecutive breached steps per series, on evaluated rows.

    Runs are found within blocks of ``BREACH_BLOCK`` steps, so that a vector of one series is not one task's. Only those
    that touch a block's border, two a block at most, are then put together in order. The vector is read once.
    """
    span = step_s * BREACH_BLOCK
    inside = Window.partitionBy(*by, "_block").orderBy("eval_t")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.when(F.col("eval_t") - F.lag("eval_t").over(inside) == step_s, 0).otherwise(1)
    hits = vector.where(breached).withColumn("_block", F.floor(F.col("eval_t") / span)).withColumn("_new", begins)
    parts = (
        hits.withColumn("_run", F.sum("_new").over(upto(inside)))
        .groupBy(*by, "_block", "_run")
        .agg(
            F.min("eval_t").alias("started_at"),
            F.max("eval_t").alias("ended_at"),
            F.count(F.lit(1)).alias("steps"),
            F.max("value").alias("peak"),
        )
    )
    at_border = (F.floor((F.col("started_at") - step_s) / span) != F.col("_block")) | (
        F.floor((F.col("ended_at") + step_s) / span) != F.col("_block")
    )
    own = F.when(~at_border, F.struct("_block", "_run"))  # null for all that may go on in another block
    across = Window.partitionBy(*by, "_own").orderBy("started_at")
    goes_on = F.when(F.col("started_at") - F.lag("ended_at").over(across) == step_s, 0).otherwise(1)
    return (
        parts.withColumn("_own", own)
        .withColumn("_new", goes_on)
        .withColumn("_episode", F.sum("_new").over(upto(across)))
        .groupBy(*by, "_own", "_episode")
        .agg(
            F.min("started_at").alias("started_at"),
            F.max("ended_at").alias("ended_at"),
            F.sum("steps").alias("steps"),
            F.max("peak").alias("peak"),
        )
        .drop("_own", "_episode")
    )
