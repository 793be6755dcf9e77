"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayer.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge; the label is the smallest node of its component.

    ``edges`` has ``a`` and ``b``, both longs. Each round is two joins and two minima, so a hub's rows are combined
    before they are shuffled and its join partition can be split. Rounds grow with the logarithm of the longest
    path. A round's edges are written to the shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = written(e, "edges"), None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = written(small.union(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
