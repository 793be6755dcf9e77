"""Named queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from assayer.plans import standins
from assayer.session import configure

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None
    covers: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def add(
    name: str, build: Build, sql: str | None = None, views: Sequence[str] = (), covers: Sequence[str] = ()
) -> None:
    """Register a query; ``views`` names the stand-in views its SQL reads."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(configure(spark), sf_dir)

    text = standins.with_views(sql, views) if sql else None
    QUERIES[name] = Query(name, run, text, tuple(covers))


def query(name: str, sql: str | None = None, views: Sequence[str] = (), covers: Sequence[str] = ()):
    """Decorator form of :func:`add`."""

    def wrap(build: Build) -> Build:
        add(name, build, sql, views, covers)
        return build

    return wrap
