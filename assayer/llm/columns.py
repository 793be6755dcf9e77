"""Column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# ASCII white space; the complement makes a word.
SPACE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def packed(df: DataFrame, **named: Column) -> DataFrame:
    """The whole input row as ``row`` beside named columns, so that no input column can clash with them."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *[c.alias(n) for n, c in named.items()])


def unpacked(df: DataFrame, *named: str) -> DataFrame:
    """Undo :func:`packed`; named columns follow the input's, whose namesakes they replace."""
    taken = {n.lower() for n in named}
    fields = [f for f in df.schema["row"].dataType.names if f.lower() not in taken]
    return df.select(*[F.col("row").getField(f).alias(f) for f in fields], *named)
