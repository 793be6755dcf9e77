"""The tree of spans of a trace: roots, depths, broken links and the time a span spends by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from assayer.functions.ordered import BLOCK
from assayer.shared import saved, stored

CHILDREN = 4096  # children of a span that one task looks at in order, on average

IDS = ["trace_id", "span_id"]


def distinct_spans(spans: DataFrame) -> DataFrame:
    """One row per span: repeated deliveries of a span count once, the least of differing ones is taken.

    Spans without a trace or an id are no part of any tree.
    """
    least = F.min(F.struct("start_us", "end_us", "parent_span_id")).alias("s")
    return spans.where("trace_id IS NOT NULL AND span_id IS NOT NULL").groupBy(*IDS).agg(least).select(*IDS, "s.*")


def numbered(spans: DataFrame) -> DataFrame:
    """Distinct spans with a number ``n`` each, written to the shared folder: ids are long and would be shuffled often."""
    own = spans.withColumn("n", F.monotonically_increasing_id())
    return stored(spans.sparkSession, saved(own, "spans"), own)


def links(own: DataFrame) -> DataFrame:
    """Numbered spans with their parent's number ``up`` and its times; the only join by the ids themselves."""
    up = own.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("n").alias("up"), F.col("start_us").alias("_from"), F.col("end_us").alias("_to"))
    linked = own.join(up, ["trace_id", "parent_span_id"], "left")
    top = F.when(F.col("up").isNull(), F.col("span_id")).alias("root_span_id")
    lost = (F.col("up").isNull() & F.col("parent_span_id").isNotNull()).alias("orphaned")
    linked = linked.select("n", "up", top, lost, "start_us", "end_us", "_from", "_to")
    return stored(own.sparkSession, saved(linked, "links"), linked)


def ancestry(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, root_span_id, depth, link) of distinct spans, by pointer doubling.

    ``link`` is ``rooted``; ``orphaned`` below a span whose parent is not in the trace, which then counts as root; or
    ``circular`` for spans whose ancestors form a ring, without root and depth.
    """
    own = numbered(spans.select(*IDS, "parent_span_id", "start_us", "end_us"))
    return own.select(*IDS, "n").join(climbed(own, links(own)), "n").drop("n")


def climbed(own: DataFrame, linked: DataFrame) -> DataFrame:
    """(n, root_span_id, depth, link) of numbered spans.

    A pointer leads from each span to an ancestor; in each round it moves on to that ancestor's own, so a chain of n
    spans is done in about log2(n) rounds. Only numbers and found roots are shuffled, and joined on the span, so that a
    busy trace spreads over all tasks; many children of one span are hot on the side that AQE splits. A round writes to
    the shared folder what it has moved; spans whose root is found stay where they were written.
    """
    spark = own.sparkSession
    hops = F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint")
    state = linked.select("n", F.col("up").alias("to"), hops.alias("hops"), "root_span_id", "orphaned")
    found, on_way = state.where("root_span_id IS NOT NULL"), state.where("root_span_id IS NULL")
    # No way up is longer than the largest trace; what is still on its way then goes round.
    longest = own.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < longest and not on_way.isEmpty():
        above = found.unionByName(on_way).select(
            F.col("n").alias("to"),
            F.col("to").alias("_to"),
            F.col("hops").alias("_hops"),
            F.col("root_span_id").alias("_root"),
            F.col("orphaned").alias("_orphaned"),
        )
        moved = on_way.select("n", "to", "hops").join(above, "to").select(
            "n",
            F.col("_to").alias("to"),
            (F.col("hops") + F.col("_hops")).alias("hops"),
            F.col("_root").alias("root_span_id"),
            F.col("_orphaned").alias("orphaned"),
        )
        moved = stored(spark, saved(moved, "moved"), moved)
        found, on_way = found.unionByName(moved.where("root_span_id IS NOT NULL")), moved.where("root_span_id IS NULL")
        reach *= 2
    rooted = F.col("root_span_id").isNotNull()
    link = F.when(~rooted, "circular").when(F.col("orphaned"), "orphaned").otherwise("rooted")
    return found.unionByName(on_way).select("n", "root_span_id", F.when(rooted, F.col("hops")).alias("depth"), link.alias("link"))


def covered(spans: DataFrame, children: int = CHILDREN) -> DataFrame:
    """(trace_id, span_id, children, covered_us): a span's children and how much of its time they cover together."""
    keys = ["trace_id", "parent_span_id"]
    parents = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("start_us").alias("_from"), F.col("end_us").alias("_to"))
    kids = spans.where("parent_span_id IS NOT NULL").select(*keys, "start_us", "end_us")
    return cover(kids.join(parents, keys), keys, children).withColumnRenamed("parent_span_id", "span_id")


def cover(kids: DataFrame, keys: list[str], children: int = CHILDREN) -> DataFrame:
    """(keys, children, covered_us) from children (start_us, end_us) with their parent's keys and times (_from, _to).

    Children may overlap and may reach beyond the span. Each adds the time between the latest end before it and its own
    end. That running maximum is taken within blocks of a span's time, sized by its number of children, and carried
    from block to block through one row per block.
    """
    inside = kids.select(
        *keys,
        "_from",
        "_to",
        F.least(F.greatest("start_us", "_from"), "_to").alias("a"),
        F.least(F.greatest("end_us", "_from"), "_to").alias("b"),
    )
    # Children that start together are one row, which reaches as far as the longest of them.
    starts = inside.groupBy(*keys, "_from", "_to", "a").agg(F.max("b").alias("b"), F.count(F.lit(1)).alias("n"))
    totals = starts.groupBy(*keys).agg(F.sum("n").alias("children"), F.count(F.lit(1)).alias("_starts"))
    width = F.greatest(F.lit(1), F.ceil((F.col("_to") - F.col("_from")) / F.ceil(F.col("_starts") / children)))
    cut = starts.join(totals, keys).withColumn(BLOCK, F.floor((F.col("a") - F.col("_from")) / width))
    earlier = lambda *by: Window.partitionBy(*keys, *by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(*keys, BLOCK).agg(F.max("b").alias("_b"))
    blocks = blocks.withColumn("_carried", F.max("_b").over(earlier().orderBy(BLOCK))).drop("_b")
    local = cut.withColumn("_local", F.max("b").over(earlier(BLOCK).orderBy("a"))).join(blocks, [*keys, BLOCK])
    reached = F.greatest("_local", "_carried", "a")  # greatest passes over nulls
    return (
        local.groupBy(*keys)
        .agg(F.max("children").alias("children"), F.sum(F.greatest(F.lit(0), F.col("b") - reached)).alias("covered_us"))
    )


def span_trees(spans: DataFrame) -> DataFrame:
    """Each span's place in its trace and the time it spends by itself.

    Rows (trace_id, span_id, root_span_id, depth, link, children, self_us): see :func:`ancestry`; ``self_us`` is the
    span's time less the part that its children cover. A span that ends before it starts has no time.
    """
    own = numbered(distinct_spans(spans))
    linked = links(own)
    took = F.greatest(F.lit(0), F.col("end_us") - F.col("start_us"))
    return (
        own.select(*IDS, "n", took.alias("_took"))
        .join(climbed(own, linked), "n")
        .join(cover(linked.where("up IS NOT NULL"), ["up"]).withColumnRenamed("up", "n"), "n", "left")
        .select(
            *IDS, "root_span_id", "depth", "link",
            F.coalesce("children", F.lit(0)).alias("children"),
            (F.col("_took") - F.coalesce("covered_us", F.lit(0))).alias("self_us"),
        )
    )


def tree_summary(trees: DataFrame) -> DataFrame:
    """One row per trace: spans, roots, deepest span, spans without a proper root, and time by itself in all spans."""
    return trees.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("spans"),
        F.count(F.when((F.col("link") != "circular") & (F.col("depth") == 0), 1)).alias("roots"),
        F.max("depth").alias("deepest"),
        F.count(F.when(F.col("link") == "orphaned", 1)).alias("orphaned"),
        F.count(F.when(F.col("link") == "circular", 1)).alias("circular"),
        F.sum("self_us").alias("self_us"),
    )
