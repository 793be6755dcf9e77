"""Mergeable sketches, stored by day: distinct counts as a guard and quantiles over any span of days.

A sketch of a day is built once, from that day's rows, by an aggregate that combines before the shuffle; longer spans
merge stored sketches and read no rows. Answers are approximate within the bounds below. The exact forms beside them are
``datasets.cardinality_guard`` and ``compare.latency_percentiles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayer.operators.datasets import cardinality_guard
from assayer.shared import saved, stored

LOG_REGISTERS = 14  # of a distinct-count sketch: a relative standard error of 1.04 / 2**7, that is 0.8 %
MARGIN = 0.05  # six standard errors
QUANTILE_SIZE = 800  # items a quantile sketch keeps on each level
RANK_ERROR = 0.0133  # of a quantile, as a share of all ranks: three times what this size misses by in 99 % of cases


def write_by_day(sketches: DataFrame, path: str, day: str = "day") -> None:
    """Store sketches by day; a day that is built again replaces its own.

    A day's sketches are brought together first, else each task writes a file of its own for each day; a day too large for
    one task is divided again.
    """
    sketches.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def daily_distinct(rows: DataFrame, keys: Sequence[str], identifier: str, day: str = "day") -> DataFrame:
    """(day, keys, ids): a sketch of the distinct identifiers of each group and day; nulls are not counted."""
    return rows.groupBy(day, *keys).agg(F.hll_sketch_agg(identifier, F.lit(LOG_REGISTERS)).alias("ids"))


def distinct_estimates(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, estimate) over all days given."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("ids")).alias("estimate"))


def sketched_guard(rows: DataFrame, sketches: DataFrame, keys: Sequence[str], identifier: str, limit: int) -> DataFrame:
    """(keys, estimate, distinct_ids, over_limit): groups that reach the limit, as the exact guard finds them.

    The sketches name the groups that may reach it (estimate within ``MARGIN``, six standard errors); only their rows are
    read and counted exactly. ``distinct_ids`` is null for all other groups. The estimates, one row per group, are stored
    once: the sketches are read once, and the join that picks the rows is planned by the size of what it looks for.
    """
    keys = list(keys)
    merged = distinct_estimates(sketches, keys)
    estimates = stored(rows.sparkSession, saved(merged, "estimates"), merged)
    near = estimates.where(F.col("estimate") >= limit * (1 - MARGIN))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    suspects = rows.select(*keys, identifier)
    counted = cardinality_guard(suspects.join(near, same(suspects, near), "left_semi"), keys, identifier, limit)
    counted = counted.withColumnsRenamed({k: f"_{k}" for k in keys})
    both = estimates.join(counted, [estimates[k].eqNullSafe(counted[f"_{k}"]) for k in keys], "left")
    return both.select(*keys, "estimate", "distinct_ids", F.coalesce("over_limit", F.lit(False)).alias("over_limit"))


def daily_quantiles(rows: DataFrame, keys: Sequence[str], value: Column, day: str = "day") -> DataFrame:
    """(day, keys, quantiles): a sketch of whole-number values of each group and day; nulls are left out."""
    sized = rows.select(day, *keys, value.cast("bigint").alias("_v")).where("_v IS NOT NULL")
    return sized.groupBy(day, *keys).agg(F.kll_sketch_agg_bigint("_v", F.lit(QUANTILE_SIZE)).alias("quantiles"))


def merged_quantiles(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, quantiles) over all days given."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_bigint("quantiles", F.lit(QUANTILE_SIZE)).alias("quantiles"))


def sketch_percentiles(sketches: DataFrame, keys: Sequence[str], points: dict[str, int]) -> DataFrame:
    """Percentiles (in thousandths) of merged sketches, each a value whose rank is off by ``RANK_ERROR`` at most."""
    found = [F.kll_sketch_get_quantile_bigint("quantiles", F.lit(t / 1000.0)).alias(p) for p, t in points.items()]
    return sketches.select(*keys, F.kll_sketch_get_n_bigint("quantiles").alias("n"), *found)


def rank_errors(rows: DataFrame, percentiles: DataFrame, keys: Sequence[str], value: Column, points: dict[str, int]) -> DataFrame:
    """(keys, n, rows, one column per point): how far each percentile's true rank lies from the wanted one, as a share.

    ``n`` is what the sketch has seen, ``rows`` what there is.
    """
    keys = list(keys)
    at = percentiles.withColumnsRenamed({k: f"_{k}" for k in keys})
    given = rows.select(*keys, value.cast("bigint").alias("_v")).where("_v IS NOT NULL")
    joined = given.join(at, [given[k].eqNullSafe(at[f"_{k}"]) for k in keys])
    counts = [
        F.sum((F.col("_v") < F.col(p)).cast("bigint")).alias(f"_below_{p}") for p in points
    ] + [F.sum((F.col("_v") <= F.col(p)).cast("bigint")).alias(f"_upto_{p}") for p in points]
    out = joined.groupBy(*keys).agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("rows"), *counts)
    share = lambda name: F.col(name) / F.col("rows")
    errors = [
        F.greatest(F.lit(0.0), share(f"_below_{p}") - t / 1000.0, t / 1000.0 - share(f"_upto_{p}")).alias(p)
        for p, t in points.items()
    ]
    return out.select(*keys, "n", "rows", *errors)
