"""Exact percentiles with bounded groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, points: dict[str, int], cell: int = 65536
) -> DataFrame:
    """Linear-interpolated percentiles of a whole-number column, one row per key.

    ``points`` maps output names to thousandths (950 = p95), so that ranks are whole-number
    arithmetic. A first pass counts values per cell of ``cell`` neighbouring values, which shrinks
    before the shuffle; it tells in which few cells the ranks lie. A second pass keeps only the rows
    of those cells and counts equal values, so that a hot key, or a hot value, costs its distinct
    values and one cell never more than ``cell`` rows. For sketches use percentile_approx.
    """
    keys = list(keys)
    cut = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("_v"), F.floor(F.col(value) / cell).alias("_cell")
    )
    by_cell = Window.partitionBy(*keys).orderBy("_cell")
    cells = (
        cut.groupBy(*keys, "_cell")
        .agg(F.count(F.lit(1)).alias("_cn"))
        .withColumn(
            "_start",
            F.coalesce(
                F.sum("_cn").over(by_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn("_total", F.sum("_cn").over(Window.partitionBy(*keys)))
    )

    def rank(thousandths: int, up: bool) -> Column:
        return F.expr(f"((_total - 1) * {thousandths} + {999 if up else 0}) div 1000")

    def holds(start: str, n: str, pos: Column) -> Column:
        return (pos >= F.col(start)) & (pos < F.col(start) + F.col(n))

    wanted = F.lit(False)
    for t in points.values():
        wanted = wanted | holds("_start", "_cn", rank(t, False)) | holds("_start", "_cn", rank(t, True))
    inside = (
        Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    )
    fine = (
        cut.join(cells.where(wanted), [*keys, "_cell"])
        .groupBy(*keys, "_cell", "_start", "_total", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_at", F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    )
    picks = [F.max("_total").alias("_total")]
    for name, t in points.items():
        for tag, up in (("lo", False), ("hi", True)):
            at_rank = F.when(holds("_at", "_n", rank(t, up)), F.col("_v"))
            picks.append(F.max(at_rank).alias(f"_{tag}_{name}"))
    out = fine.groupBy(*keys).agg(*picks)
    return out.select(
        *keys,
        *[
            (F.expr(
                f"_lo_{name} * (1000 - (_total - 1) * {t} % 1000) + _hi_{name} * ((_total - 1) * {t} % 1000)"
            ).cast("double") / 1000.0).alias(name)
            for name, t in points.items()
        ],
    )
