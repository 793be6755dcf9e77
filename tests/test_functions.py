from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from assayer.functions import numbers, ordered, text
from assayer.functions.quantiles import exact_percentiles


def test_py_round_agrees_with_python(spark):
    rng = random.Random(5)
    values = [0.15, 92.85, 2.5, 0.25, 0.35, -0.15, -2.25, 1.005, 0.0, 1e9 + 0.05, 0.05, 8.345]
    values += [rng.uniform(-1000, 1000) for _ in range(2000)]
    values += [round(rng.uniform(0, 1000), 2) for _ in range(4000)]
    values += [1e13 + 0.37, -1e13 - 0.37, 2**52 + 0.5, 2.0**53, 1e300, float("inf"), 4503599627370497.5 / 8]
    values += [rng.uniform(-1, 1) * 2.0 ** rng.randrange(40, 60) for _ in range(2000)]
    for digits in (1, 2):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        got = [r.y for r in df.select(numbers.py_round(F.col("x"), digits).alias("y")).collect()]
        assert [(v, y) for v, y in zip(values, got) if y != round(v, digits)] == []


def test_metric_division_and_scalar_default(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (0.0, 0.0), (None, 1.0)], "a double, b double")
    q = numbers.metric_div(F.col("a"), F.col("b"))
    rows = [(str(r.q), r.s) for r in df.select(q.alias("q"), numbers.scalar_or_default(q).alias("s")).collect()]
    assert rows == [("0.5", 0.5), ("inf", 0.0), ("nan", 0.0), ("None", 0.0)]


def test_strict_json_agrees_with_python(spark):
    cases = [
        '{"a":1}', '{"a":1} x', '{"a":1', "", " ", "null", "1", '"s"', "[1,2]", "[1,2],[3]", "{'a':1}", '{"a":1,"a":2}',
        '1,"value":2', '{"a":1}}', '1} {"b":2', "nul", "01", "NaN", '{"a":"b\nc"}', ' {"a": [1, {"b": null}]} ', "tru", '"\\u00e9"', "-1.5e3", "{}",
        '1,"seal":0} junk', "é", "+INF", "-INF", "INF", "Infinity", "-Infinity", "+Infinity", "[+INF]", "[NaN, -Infinity]",
        '{"a": "NaN +INF"}', '["Infinity", INF]', "NaNx", "-NaN", '{"NaN": Infinity}', '["\\"", NaN]', '"Infinity', "1Infinity", "[NaN,]",
    ]

    def valid(t: str) -> bool:
        try:
            json.loads(t)
            return True
        except json.JSONDecodeError:
            return False

    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r.v for r in df.select(text.strict_json(F.col("t")).alias("v")).collect()]
    assert [(c, g) for c, g in zip(cases, got) if g != valid(c)] == []
    assert spark.range(1).select(text.strict_json(F.lit(None).cast("string")).alias("v")).first().v is False


def test_word_count_splits_like_python(spark):
    cases = ["a b", "", "  a b\u0085c ", "a\x1cb", "x y　z", "one", "a\n\tb", "zero​width"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r.n for r in df.select(text.word_count(F.col("t")).alias("n")).collect()]
    assert got == [len(c.split()) for c in cases]


def test_contains_terms(spark):
    df = spark.createDataFrame(
        [("The Answer is 5 CENTS", ["answer", "cents"]), ("five", ["5", "five"]), ("x", None), ("x", [])],
        "t string, terms array<string>",
    )
    both = df.select(
        text.contains_terms(F.col("t"), F.col("terms")).alias("all"),
        text.contains_terms(F.col("t"), F.col("terms"), "any").alias("any"),
    ).collect()
    assert [tuple(r) for r in both] == [(True, True), (False, True), (True, True), (True, True)]


def test_running_sum_over_blocks_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.randint(-5, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint").repartition(5)
    got = ordered.running_sum(df, ["k"], F.floor(F.col("i") / 50), ["i"], F.col("v"), "s")
    expected, sums = {}, {}
    for k, i, v in rows:
        sums[k] = sums.get(k, 0) + v
        expected[i] = sums[k]
    assert {r.i: r.s for r in got.collect()} == expected


def test_exact_percentiles_with_one_value_dominating(spark):
    rows = [("a", 30_000_000)] * 900 + [("a", i * 37) for i in range(600)] + [("b", 5)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    out = {r.k: r for r in exact_percentiles(df, ["k"], "v", {"p50": 500, "p95": 950}).collect()}
    values = sorted(v for k, v in rows if k == "a")
    pos = (len(values) - 1) * 500
    lo, hi, rest = values[pos // 1000], values[-(-pos // 1000)], pos % 1000
    assert out["a"].p50 == (lo * (1000 - rest) + hi * rest) / 1000
    assert out["a"].p95 == 30_000_000 and out["b"].p50 == 5


def test_token_counter_hook(spark):
    count = text.token_counter(lambda: str.split)
    df = spark.createDataFrame([("a b c",), (None,)], "t string")
    assert [r.n for r in df.select(count(F.col("t")).alias("n")).collect()] == [3, None]


def test_token_counts_by_parts_are_those_of_whole_texts(spark):
    import random

    from assayer.plans.dataset_queries import public_encoder

    rng, encode = random.Random(3), public_encoder("byte_bpe_50k.json")()
    signs = ["a", "word", "Don't", "!", "?!", "12", "é", "日本", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u180e", "\u200b", "\u3000", "<|endoftext|>"]
    texts = ["", " ", "a ", " a  b\n c"] + ["".join(rng.choices(signs, k=rng.randrange(1, 30))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    count = text.token_counter(public_encoder("byte_bpe_50k.json"), text.BYTE_LEVEL_PART)
    got = {r.t: r.n for r in df.select("t", count(F.col("t")).alias("n")).collect()}
    assert got == {t: len(encode(t)) for t in texts}


def test_token_counter_remembers_parts(spark):
    def make():
        calls = []
        return lambda t: calls.append(t) or calls

    df = spark.createDataFrame([("a a a a",)], "t string").coalesce(1)
    # Each call returns one more: " a" is encoded once, "a" once.
    assert df.select(text.token_counter(make, text.BYTE_LEVEL_PART)(F.col("t"))).first()[0] == 1 + 2 * 3
