"""Ordered scans that do not put a whole key into one task.

A window over a hot key sorts all its rows in one task. Here the caller names a block: an
expression that cuts the ordering into pieces (a time bucket, a range of line numbers, the top
bits of a hash). Blocks must follow the order. Work inside a block is one window over (key, block),
the pieces are joined through one summary row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = "_block"


def _offsets(df: DataFrame, keys: Sequence[str], amount: Column) -> DataFrame:
    sums = df.groupBy(*keys, BLOCK).agg(F.sum(amount).alias("_amount"))
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        *keys, BLOCK, F.coalesce(F.sum("_amount").over(before), F.lit(0)).alias("_before")
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column | str], amount: Column, out: str
) -> DataFrame:
    """Inclusive running sum of ``amount`` per key; keys must not be null."""
    cut = df.withColumn(BLOCK, block)
    inside = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = cut.withColumn("_local", F.sum(amount).over(inside))
    return (
        local.join(_offsets(cut, keys, amount), [*keys, BLOCK])
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_before", "_local", BLOCK)
    )


def numbered(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column | str], out: str
) -> DataFrame:
    """1-based position of each row within its key, in the given order."""
    return running_sum(df, keys, block, order, F.lit(1).cast("bigint"), out)
