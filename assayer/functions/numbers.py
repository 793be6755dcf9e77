"""Rounding, exact totals and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def py_round(x: Column, digits: int) -> Column:
    """Python's ``round``: nearest on the binary value, ties to even.

    ``F.round`` and ``F.bround`` work on the printed decimal and so round 0.15 up; the
    product error below (Dekker's splitting) tells on which side of the tie x really is.
    """
    m = F.lit(float(10**digits))
    x = x.cast("double")
    scaled = x * m
    wide = x * F.lit(134217729.0)
    hi = wide - (wide - x)
    err = (hi * m - scaled) + (x - hi) * m
    low = F.floor(scaled).cast("double")
    side = (scaled - low - F.lit(0.5)) + err
    up = (side > 0) | ((side == 0) & (F.abs(low % 2) == 1))
    rounded = (low + F.when(up, 1.0).otherwise(0.0)) / m
    # From 2**53 units of the last digit on, neighbouring doubles lie a unit or more apart: x is its own rounding.
    return F.when(F.abs(scaled) < float(2**53), rounded).otherwise(x)


def whole(x: Column) -> Column:
    """Nearest whole number as BIGINT. F.round on DOUBLE goes through BigDecimal for each row."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def micros(ms: Column) -> Column:
    """Milliseconds as whole microseconds, the unit in which totals are exact."""
    return whole(ms * 1000)


def ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, null when den is 0 or null."""
    den = den.cast("double")
    return num.cast("double") / F.when(den != 0, den)


def metric_div(num: Column, den: Column) -> Column:
    """IEEE division as metric engines do it: x/0 is +Inf or -Inf, 0/0 is NaN."""
    num, den = num.cast("double"), den.cast("double")
    return (
        F.when(den != 0, num / F.when(den != 0, den))
        .when(den.isNull() | num.isNull(), F.lit(None).cast("double"))
        .when((num == 0) | F.isnan(num), F.lit(float("nan")))
        .when(num > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )


def scalar_or_default(x: Column, default: float = 0.0) -> Column:
    """NaN, infinities and null become the default."""
    x = x.cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(finite, x).otherwise(F.lit(default))


def fold_bool(c: Column) -> Column:
    """1 for true, 0 for false or null."""
    return F.when(c, 1).otherwise(0).cast("bigint")
