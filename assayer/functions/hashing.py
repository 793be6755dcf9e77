"""Stable hashes that any engine with SHA-256 can reproduce."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash32(text: Column) -> Column:
    """First 32 bits of SHA-256 as a non-negative BIGINT."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def bucket_of(text: Column, n: Column | int) -> Column:
    """Bucket 0..n-1 of a text."""
    return F.pmod(hash32(text), F.lit(n) if isinstance(n, int) else n)


def short_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256: the identity kept instead of raw text."""
    return F.substring(F.sha2(text, 256), 1, 16)
