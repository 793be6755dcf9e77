"""Batch inference and judging through a caller-supplied client."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

# Fixed value: tokens asked for when a prompt does not say.
DEFAULT_MAX_TOKENS = 100

Client = Callable[[pd.DataFrame], pd.DataFrame]


def call_model(
    calls: DataFrame, make_client: Callable[[], Client], schema: str | StructType, partitions: int | None = None
) -> DataFrame:
    """Answers for calls (…, prompt, max_tokens), one client per task.

    The client gets Arrow batches of calls and returns their answer rows. ``partitions`` spreads the
    calls evenly first, and so bounds how many clients work at once.
    """
    if "max_tokens" in calls.columns:
        calls = calls.withColumn("max_tokens", F.coalesce("max_tokens", F.lit(DEFAULT_MAX_TOKENS)))
    else:
        calls = calls.withColumn("max_tokens", F.lit(DEFAULT_MAX_TOKENS))
    if partitions:
        calls = calls.repartition(partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            yield client(batch)

    return calls.mapInPandas(run, schema)
