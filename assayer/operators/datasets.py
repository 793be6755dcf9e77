"""Prompt datasets: building, merging, splitting, checking, digests and manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.hashing import hash32
from assayer.functions.ordered import numbered
from assayer.functions.quantiles import exact_percentiles
from assayer.functions.numbers import fold_bool, ratio
from assayer.functions.text import normalised

# Bucket bounds, default target, manifest fields, input length rule.
SHORT_MAX, MEDIUM_MAX, DEFAULT_TARGET = 75, 300, 50
OUTPUT_BUCKETS = (50, 200, 800)
INPUT_MIN, INPUT_MAX = 10, 500
TARGET_MIX = {"short": 0.4, "medium": 0.4, "long": 0.2}
# Shares in thousandths.
DOMAIN_SPLITS = {"train": 700, "eval_holdout": 200, "canary_never_train": 100}
SOURCE_MIX = {"synthetic": 600, "curated": 300, "adversarial": 100}
PERCENTAGES = (10, 15, 20, 25, 30, 40, 50, 60, 75, 80)
BLOCK = 4096
LINES_PER_BLOCK = 65536


def assign_bucket(tokens: Column) -> Column:
    return F.when(tokens <= SHORT_MAX, "short").when(tokens <= MEDIUM_MAX, "medium").otherwise("long")


def normalise_prompts(df: DataFrame, scenario_id: str | Column, dataset_id: str | Column) -> DataFrame:
    """The eleven prompt columns; scenario and dataset are the set's, the prompt's own scenario is
    kept in ``metadata``. Columns the input lacks are null."""

    def have(name: str, kind: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    scenario = F.lit(scenario_id) if isinstance(scenario_id, str) else scenario_id
    dataset = F.lit(dataset_id) if isinstance(dataset_id, str) else dataset_id
    own = have("scenario_id", "string")
    kept = F.when(own.isNotNull(), F.create_map(F.lit("source_scenario"), own))
    metadata = have("metadata", "map<string,string>")
    merged = F.when(kept.isNull(), metadata).when(metadata.isNull(), kept).otherwise(F.map_concat(metadata, kept))
    target = have("target_output_tokens", "bigint")
    extra = [c for c in ("line_no",) if c in df.columns]
    return df.select(
        *extra,
        "prompt_id",
        "prompt",
        scenario.alias("scenario_id"),
        dataset.alias("dataset_id"),
        have("expected_contains", "array<string>").alias("expected_contains"),
        have("expected_format", "string").alias("expected_format"),
        target.alias("target_output_tokens"),
        assign_bucket(F.coalesce(target, F.lit(DEFAULT_TARGET))).alias("bucket"),
        have("category", "string").alias("category"),
        have("split", "string").alias("split"),
        merged.alias("metadata"),
    )


def number_prompts(rows: DataFrame, prefix: str, order: str = "line_no") -> DataFrame:
    """``prefix-001`` ids in file order; blocks of lines keep a large prefix off one task."""
    block = F.floor(F.col(order) / LINES_PER_BLOCK)
    out = numbered(rows, [prefix], block, [order], "_no")
    return out.withColumn("prompt_id", F.format_string("%s-%03d", F.col(prefix), F.col("_no"))).drop("_no")


def expand(rows: DataFrame, default_max: int = 200) -> DataFrame:
    """Compact rows (prefix, line_no, prompt, expected, max_tokens, category) to prompts."""
    return number_prompts(rows, "prefix").withColumns(
        {
            "expected_contains": F.col("expected"),
            "target_output_tokens": F.coalesce("max_tokens", F.lit(default_max)),
        }
    ).drop("expected", "max_tokens")


def concatenate(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All sources with their tag and rank; the mapping's order is the priority."""
    return concatenate(
        [df.withColumns({"source": F.lit(name), "priority": F.lit(i)}) for i, (name, df) in enumerate(sources.items())]
    )


def draw(seed: int | Column, key: Column, slot: int, low: int, high: int) -> Column:
    """Whole number in [low, high] from (seed, key, slot): the same under any partitioning."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.pmod(hash32(F.concat_ws(":", seed, key, F.lit(slot))), F.lit(high - low + 1)) + low


def arithmetic_prompts(keys: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One arithmetic question per key, six kinds in turn, with its computed answer."""
    k = F.col(key).cast("string")

    def d(slot: int, low: int, high: int) -> Column:
        return draw(seed, k, slot, low, high)

    mul = (d(0, 10, 99), d(1, 10, 99))
    power = (d(0, 2, 9), d(1, 2, 5))
    div = (d(0, 100, 999), d(1, 2, 20))
    percent = F.element_at(F.array(*[F.lit(p) for p in PERCENTAGES]), d(0, 1, len(PERCENTAGES)).cast("int"))
    whole = d(1, 50, 500) * 2
    steps = (d(0, 2, 20), d(1, 2, 20), d(2, 2, 20))
    plus = (d(0, 1, 100), d(1, 1, 100))
    kinds = [
        (F.format_string("Calculate %d * %d.", *mul), mul[0] * mul[1]),
        (F.format_string("What is %d^%d?", *power), F.round(F.pow(power[0], power[1])).cast("bigint")),
        (
            F.format_string("What is %d divided by %d? Give the integer part.", *div),
            F.floor(div[0].cast("double") / div[1].cast("double")),
        ),
        (F.format_string("What is %d%% of %d?", percent, whole), F.floor(percent * whole / 100.0)),
        (F.format_string("Calculate (%d + %d) * %d.", *steps), (steps[0] + steps[1]) * steps[2]),
        (F.format_string("What is %d + %d?", *plus), plus[0] + plus[1]),
    ]
    kind = F.pmod(F.col(key), F.lit(len(kinds)))
    prompt, answer = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for i, (text, value) in enumerate(kinds):
        prompt = F.when(kind == i, text).otherwise(prompt)
        answer = F.when(kind == i, value).otherwise(answer)
    return keys.select(
        key,
        prompt.alias("prompt"),
        F.array(answer.cast("string")).alias("expected_contains"),
        F.when(kind == len(kinds) - 1, 50).otherwise(100).alias("max_tokens"),
        F.lit("math").alias("category"),
    )


def pair_prompts(pairs: DataFrame, template: str, subject: str, answer: str, max_tokens: int = 50) -> DataFrame:
    """A question per (subject, answer) row; ``template`` holds one %s."""
    return pairs.select(
        subject,
        F.format_string(template, F.col(subject)).alias("prompt"),
        F.array(F.col(answer)).alias("expected_contains"),
        F.lit(max_tokens).alias("max_tokens"),
    )


def expand_templates(
    rows: DataFrame, template: str, column: str, variables: Mapping[str, Sequence[str]], target_by: str, targets: Mapping[str, int]
) -> DataFrame:
    """Every value combination of a ``{name}`` template: one variable is a column of ``rows``, the
    others are short configured lists and multiply each row in place."""
    out = rows
    for name, values in variables.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    text = F.lit(template)
    for name in (column, *variables):
        text = F.replace(text, F.lit("{" + name + "}"), F.col(name))
    target = F.lit(None).cast("bigint")
    for value, tokens in targets.items():
        target = F.when(F.col(target_by) == value, F.lit(tokens).cast("bigint")).otherwise(target)
    return out.withColumns({"prompt": text, "target_output_tokens": target}).withColumn(
        "bucket", assign_bucket(F.col("target_output_tokens"))
    )


# ---- splits, mixes, duplicates -------------------------------------------------------------------


def split_of(key: Column, splits: Mapping[str, int], seed: int | None = None) -> Column:
    """Split by hash thresholds in thousandths; equal keys share a split. Pass the normalised text
    as the key to keep one text out of two splits."""
    h = F.pmod(hash32(key if seed is None else F.concat_ws(":", F.lit(seed), key)), F.lit(1000))
    out, low = F.lit(None).cast("string"), 0
    for name, share in splits.items():
        out = F.when((h >= low) & (h < low + share), name).otherwise(out)
        low += share
    return out


def hash_ranked(df: DataFrame, strata: Sequence[str], key: Column, unique: str, out: str = "rank") -> DataFrame:
    """Position by hash within each stratum; the hash's top bits are the blocks, so they are even."""
    hashed = df.withColumn("_h", hash32(key))
    return numbered(hashed, strata, F.floor(F.col("_h") / 65536), ["_h", unique], out).drop("_h")


def quota_split(df: DataFrame, domain: str, key: Column, unique: str, splits: Mapping[str, int]) -> DataFrame:
    """Exact shares per domain: rows in hash order, cut at the cumulative shares."""
    ranked = hash_ranked(df, [domain], key, unique, "_rank")
    sizes = df.groupBy(domain).agg(F.count(F.lit(1)).alias("_size"))
    joined = ranked.join(sizes, domain)
    names, edges, low = list(splits), [], 0
    for name in names:
        low += splits[name]
        edges.append(low)
    split = F.lit(names[-1])
    for name, edge in reversed(list(zip(names[:-1], edges[:-1]))):
        split = F.when(F.col("_rank") * 1000 <= F.col("_size") * edge, name).otherwise(split)
    return joined.withColumn("split", split).drop("_rank", "_size")


def leaked(prompts: DataFrame, text: Column, never: str = "canary_never_train", train: str = "train") -> DataFrame:
    """Training rows whose normalised text also stands in the never-train split."""
    keyed = prompts.withColumn("_text", F.sha2(normalised(text), 256))
    held = keyed.where(F.col("split") == never).select("_text").distinct()
    return keyed.where(F.col("split") == train).join(held, "_text", "left_semi").drop("_text")


def source_mix(df: DataFrame, source: str, key: Column, unique: str, total: int | Column, mix: Mapping[str, int] = SOURCE_MIX) -> DataFrame:
    """The first rows of each source in hash order, up to its share (thousandths) of ``total``."""
    quota = F.lit(0).cast("bigint")
    whole = total if isinstance(total, Column) else F.lit(total)
    for name, share in mix.items():
        quota = F.when(F.col(source) == name, F.floor(whole * share / 1000)).otherwise(quota)
    return hash_ranked(df, [source], key, unique).where(F.col("rank") <= quota)


def deduplicate(df: DataFrame, text: str, priority: str, unique: str) -> DataFrame:
    """One row per normalised text: best priority, then smallest id, which is unique and not null.

    The winner is picked on keys alone, whose copies are combined before the shuffle; a text with very many copies is
    no hot key. Texts are normalised and hashed once; whole rows are only joined to their winners by id.
    """
    keyed = df.select(F.sha2(normalised(F.col(text)), 256).alias("text_key"), priority, unique)
    best = keyed.groupBy("text_key").agg(F.min(F.struct(priority, unique)).alias("_best"), F.count(F.lit(1)).alias("copies"))
    winners = best.select("text_key", F.col("_best")[unique].alias(unique), "copies")
    return df.join(winners, unique).select("text_key", *df.columns, "copies")


# ---- checks and statistics -----------------------------------------------------------------------


def violations(prompts: DataFrame, tokens: Column) -> DataFrame:
    """Adds ``violated``: names of the schema rules a row breaks."""
    repeated = (
        prompts.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("prompt_id", F.lit(True).alias("_dup"))
    )
    target = F.coalesce("target_output_tokens", F.lit(DEFAULT_TARGET))
    rules = {
        "prompt_id_missing": F.col("prompt_id").isNull() | (F.col("prompt_id") == ""),
        "prompt_missing": F.col("prompt").isNull() | (F.trim("prompt") == ""),
        "duplicate_prompt_id": F.coalesce("_dup", F.lit(False)),
        "token_range": ~tokens.between(INPUT_MIN, INPUT_MAX),
        "bucket_mismatch": F.col("bucket") != assign_bucket(target),
    }
    names = F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    return prompts.join(repeated, "prompt_id", "left").withColumn("violated", F.array_compact(names)).drop("_dup")


def bucket_mix(prompts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of each output bucket against its target."""
    counts = prompts.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("prompts"))
    totals = prompts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    target = F.lit(None).cast("double")
    for name, share in TARGET_MIX.items():
        target = F.when(F.col("bucket") == name, F.lit(share)).otherwise(target)
    joined = counts.join(totals, list(keys)) if keys else counts.withColumn("_total", totals.select("_total").scalar())
    return joined.withColumns({"share": ratio(F.col("prompts"), F.col("_total")), "target_share": target}).drop("_total")


def length_stats(prompts: DataFrame, keys: Sequence[str], tokens: Column) -> DataFrame:
    """Smallest, largest, median and p95 length, and rows outside the input range."""
    sized = prompts.select(*keys, tokens.alias("_tokens"))
    base = sized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("prompts"),
        F.min("_tokens").alias("min_tokens"),
        F.max("_tokens").alias("max_tokens"),
        F.sum(fold_bool(~F.col("_tokens").between(INPUT_MIN, INPUT_MAX))).alias("out_of_range"),
    )
    return base.join(exact_percentiles(sized, keys, "_tokens", {"p50_tokens": 500, "p95_tokens": 950}), list(keys))


def cardinality_guard(rows: DataFrame, keys: Sequence[str], identifier: str, limit: int) -> DataFrame:
    """Distinct identifiers per group and whether the limit is reached; counted exactly by two
    aggregates, the first of which spreads a large group over its identifiers."""
    return (
        rows.groupBy(*keys, identifier)
        .agg(F.lit(1).alias("_one"))
        .groupBy(*keys)
        .agg(F.count(identifier).alias("distinct_ids"))
        .withColumn("over_limit", F.col("distinct_ids") >= limit)
    )


# ---- identity of a set ---------------------------------------------------------------------------


def content_digest(rows: DataFrame, keys: Sequence[str], line_no: str, content: Column, levels: int = 4) -> DataFrame:
    """Digest over ordered content without an ordered single stream.

    Row digests are hashed per block of 4096 consecutive lines, blocks per 4096 blocks, and so on
    (four levels reach 2.8e14 lines; a last one joins whatever is left beyond). It depends on content and line numbers only, not on
    partitions. It is not the digest of the file; see sources.promptsets.file_digests for that.
    """
    level = rows.select(*keys, F.col(line_no).alias("_pos"), F.sha2(content, 256).alias("_digest"))
    for _ in range(levels):
        ordered = F.array_sort(F.collect_list(F.struct("_pos", "_digest")))
        joined = F.concat_ws("", F.transform(ordered, lambda x: x["_digest"]))
        level = (
            level.groupBy(*keys, F.floor(F.col("_pos") / BLOCK).alias("_next"))
            .agg(F.sha2(joined, 256).alias("_digest"))
            .withColumnRenamed("_next", "_pos")
        )
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_digest")))
    rest = F.sha2(F.concat_ws("", F.transform(ordered, lambda x: x["_digest"])), 256)
    return level.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) == 1, F.min("_digest")).otherwise(rest).alias("content_digest")
    )


def manifest(
    prompts: DataFrame, created_at: Column, seed: int = 42, version: str = "1.0.0", checksum: DataFrame | None = None
) -> DataFrame:
    """One manifest row per (scenario, dataset); the creation time is an input."""
    keys = ["scenario_id", "dataset_id"]
    counted = prompts.groupBy(*keys).agg(F.count(F.lit(1)).alias("prompt_count"))
    if checksum is not None:
        counted = counted.join(checksum, keys, "left")
    else:
        counted = counted.withColumn("checksum", F.lit(None).cast("string"))
    return counted.select(
        F.concat_ws("-", "dataset_id", F.date_format(created_at, "yyyyMMdd")).alias("promptset_id"),
        *keys,
        F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at"),
        F.lit(seed).cast("bigint").alias("seed"),
        "prompt_count",
        F.struct(F.lit("text").alias("format")).alias("expected_output_schema"),
        F.struct(
            F.struct(F.lit(INPUT_MIN).cast("bigint").alias("min"), F.lit(INPUT_MAX).cast("bigint").alias("max")).alias("input_tokens"),
            F.struct(F.array(*[F.lit(b).cast("bigint") for b in OUTPUT_BUCKETS]).alias("buckets")).alias("output_tokens"),
        ).alias("target_buckets"),
        "checksum",
        F.lit(version).alias("version"),
        F.lit(">=2.0.0").alias("compatible_harness_version"),
    )
