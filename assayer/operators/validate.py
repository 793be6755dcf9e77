"""Response text, checks against expectations, token counts and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.numbers import py_round
from assayer.functions.text import contains_terms, strict_json, word_count

PREVIEW_CHARS = 200


def response_text(output: Column, response: Column) -> Column:
    """The gateway's ``output``; an empty one falls through to ``response``, then to ''."""
    return F.coalesce(F.nullif(output, F.lit("")), response, F.lit(""))


def format_ok(expected: Column, text: Column) -> Column:
    """Only the JSON format is checked; the parser sees no other rows."""
    return (expected.isNull() | (expected != "json")) | strict_json(F.when(expected == "json", text))


def validate(
    text: Column,
    expected_contains: Column,
    expected_format: Column,
    error: Column,
    match: str = "all",
    json_text: Column | None = None,
) -> Column:
    """Terms and format both hold; an error row never passes.

    ``json_text`` lets a caller check the raw ``response`` field instead of the coalesced text,
    as the original harness does.
    """
    good = contains_terms(text, expected_contains, match) & format_ok(
        expected_format, text if json_text is None else json_text
    )
    return error.isNull() & good


def tokens_generated(reported: Column, text: Column) -> Column:
    return F.coalesce(reported.cast("bigint"), word_count(text))


def tokens_per_second(tokens: Column, latency_ms: Column) -> Column:
    """One decimal, 0 where no time passed."""
    seconds = F.when(latency_ms > 0, latency_ms / F.lit(1000.0))
    return F.coalesce(py_round(tokens.cast("double") / seconds, 1), F.lit(0.0))


def preview(text: Column) -> Column:
    return F.substring(text, 1, PREVIEW_CHARS)


def exact_match(text: Column, answer: Column) -> Column:
    return F.trim(text) == F.trim(answer)


def numerical_accuracy(text: Column, answer: Column, tolerance: float = 1e-9) -> Column:
    """Some number in the text equals the expected number within a relative tolerance.

    Numbers may have an exponent or begin with their point; a minus behind a digit is a dash.
    """
    target = F.regexp_replace(F.trim(answer), ",", "").try_cast("double")
    plain = F.regexp_replace(F.regexp_replace(text, r"(\d),(?=\d{3})", "$1"), r"(\d)-", "$1 ")
    numbers = F.regexp_extract_all(plain, F.lit(r"(-?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?)"), 1)
    near = F.exists(numbers, lambda n: F.abs(n.try_cast("double") - target) <= F.abs(target) * F.lit(tolerance))
    return F.coalesce(near, F.lit(False))


def to_results(joined: DataFrame, team: Column, match: str = "all", strict_reference: bool = False) -> DataFrame:
    """Prompt/response rows to harness results.

    ``joined`` carries the prompt columns and ``output, response, tokens_reported, latency_ms,
    error``. ``strict_reference`` reproduces two quirks of the original: the format check reads
    ``response`` alone, and an error row loses its category.
    """
    text = response_text(F.col("output"), F.col("response"))
    failed = F.col("error").isNotNull()
    staged = joined.withColumn("_text", F.when(failed, F.lit("")).otherwise(text))
    tokens = F.when(failed, F.lit(0)).otherwise(
        tokens_generated(F.col("tokens_reported"), F.col("_text"))
    )
    json_text = F.coalesce(F.col("response"), F.lit("")) if strict_reference else None
    category = F.when(~failed, F.col("category")) if strict_reference else F.col("category")
    return staged.withColumn("tokens_generated", tokens).select(
        "run_id",
        "prompt_id",
        team.alias("team"),
        F.coalesce(F.col("variant"), F.lit("default")).alias("variant"),
        F.coalesce(F.col("scenario_id"), F.lit("unknown")).alias("scenario_id"),
        F.coalesce(F.col("dataset_id"), F.lit("unknown")).alias("dataset_id"),
        validate(
            F.col("_text"), F.col("expected_contains"), F.col("expected_format"), F.col("error"), match, json_text
        ).alias("passed"),
        "latency_ms",
        "error",
        F.when(~failed, preview(F.col("_text"))).alias("response_preview"),
        "tokens_generated",
        F.when(failed, F.lit(0.0))
        .otherwise(tokens_per_second(F.col("tokens_generated"), F.col("latency_ms")))
        .alias("tokens_per_second"),
        category.alias("category"),
        F.when(~failed, F.coalesce(F.col("model_version"), F.lit("unknown"))).alias("model_version"),
    )
