from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from assayer.functions.labels import Match, all_match, promote, relabel
from assayer.operators import metrics as m

SAMPLES = "job string, t bigint, value double"


def samples(spark, *points, job="a"):
    return spark.createDataFrame([(job, t, float(v)) for t, v in points], SAMPLES)


def at(df, t):
    return [r for r in df.collect() if r.eval_t == t]


def test_increase_with_a_reset_inside_and_between_steps(spark):
    s = samples(spark, (0, 10), (10, 15), (20, 3), (40, 8), (70, 2), (80, 4))
    out = m.increase(s, ["job"], ["job"], 120, 30)
    # 5 + restart to 3 + 5 + restart to 2 + 2
    assert at(out, 120)[0].increase == 17.0
    # at 150 the samples before 30 have left: 8 -> restart 2 -> 4
    assert at(out, 150)[0].increase == 4.0


def test_single_sample_in_a_window_gives_no_row(spark):
    out = m.increase(samples(spark, (5, 1)), ["job"], ["job"], 60, 30)
    assert out.count() == 0
    gap = m.increase(samples(spark, (5, 1), (300, 9)), ["job"], ["job"], 60, 30)
    assert gap.count() == 0


def test_rate_does_not_depend_on_the_counter_offset(spark):
    points = [(t, t // 7) for t in range(0, 600, 15)]
    low = m.rate(samples(spark, *points), ["job"], [], 300, 30)
    high = m.rate(samples(spark, *[(t, v + 1000) for t, v in points]), ["job"], [], 300, 30)
    assert sorted(map(tuple, low.collect())) == sorted(map(tuple, high.collect()))


def test_share_drops_groups_without_a_match(spark):
    s = samples(spark, (0, 0), (10, 6), job="200").unionByName(samples(spark, (0, 0), (10, 2), job="500"))
    s = s.withColumn("svc", F.lit("x")).unionByName(samples(spark, (0, 0), (10, 2), job="200").withColumn("svc", F.lit("y")))
    out = m.increase_share(s, ["svc", "job"], ["svc"], all_match([Match("job", "=~", "5..")]), 60, 30)
    assert [(r.svc, r.value) for r in at(out, 30)] == [("x", 0.25)]


def test_extrapolation_by_hand(spark):
    # Samples at 10..50 every 10 s gain 4; window [0, 60): 10 s to each border, under 1.1 gaps.
    s = samples(spark, *[(t, 100 + t / 10) for t in range(10, 60, 10)])
    out = m.extrapolated_increase(s, ["job"], 60, 30)
    assert at(out, 60)[0].increase == pytest.approx(4.0 * 60 / 40)
    # A counter starting near zero is not stretched below zero: 1 -> 5, zero is 10 s away.
    near = m.extrapolated_increase(samples(spark, *[(t, t / 10) for t in range(10, 60, 10)]), ["job"], 60, 30)
    assert at(near, 60)[0].increase == pytest.approx(4.0 * 60 / 40)
    late = m.extrapolated_increase(samples(spark, (40, 100), (50, 101)), ["job"], 60, 30)
    # 40 s to the start is more than 1.1 gaps: half a gap; 10 s to the end: all of it.
    assert at(late, 60)[0].increase == pytest.approx(1.0 * (10 + 5 + 10) / 10)


def quantile(spark, q, *counts):
    bounds = ["0.5", "1", "2.5", "+Inf"]
    rows = [("g", 60, le, float(c)) for le, c in zip(bounds, counts)]
    df = spark.createDataFrame(rows, "g string, eval_t bigint, le string, increase double")
    return m.histogram_quantile(q, df, ["g"]).first().value


@pytest.mark.parametrize(
    "q, counts, expected",
    [
        (0.5, (10, 10, 10, 10), 0.25),  # all in the first bucket, from zero
        (0.5, (0, 10, 10, 10), 0.75),
        (0.95, (10, 20, 40, 40), 1 + 1.5 * 18 / 20),
        (0.95, (0, 0, 0, 10), 2.5),  # all mass above the last bound
        (0.95, (5, 3, 10, 10), 1 + 1.5 * 4.5 / 5),  # a falling count is lifted
    ],
)
def test_histogram_quantile(spark, q, counts, expected):
    assert quantile(spark, q, *counts) == pytest.approx(expected)


def test_empty_histogram_is_nan(spark):
    assert math.isnan(quantile(spark, 0.95, 0, 0, 0, 0))


def test_instant_respects_the_lookback(spark):
    out = m.instant(samples(spark, (5, 1), (65, 2), (70, 3)), ["job"], 30, 90)
    assert {r.eval_t: r.value for r in out.collect()} == {30: 1.0, 60: 1.0, 90: 3.0, 120: 3.0, 150: 3.0}


def test_max_over_time(spark):
    out = m.max_over_time(samples(spark, (5, 9), (35, 2)), ["job"], 60, 30)
    assert {r.eval_t: r.value for r in out.collect()} == {30: 9.0, 60: 9.0, 90: 2.0}


def test_in_flight_across_ticks(spark):
    spans = spark.createDataFrame([("a", 0, 130), ("a", 10, 20), ("a", 70, 130)], "team string, s bigint, e bigint")
    us = spans.selectExpr("team", "s * 1000000 AS s", "e * 1000000 AS e")
    got = {r.t: (r.level, r.peak) for r in m.in_flight(us, ["team"], "s", "e", 60).collect()}
    assert got == {0: (1, 2), 60: (2, 2), 120: (0, 0)}


def test_breach_episodes(spark):
    rows = [(t, v) for t, v in [(0, 6.0), (30, 7.0), (60, 1.0), (90, 9.0)]]
    df = spark.createDataFrame(rows, "eval_t bigint, value double").withColumn("g", F.lit("x"))
    got = [(r.started_at, r.ended_at, r.steps, r.peak) for r in m.breach_episodes(df, ["g"], F.col("value") > 5, 30).collect()]
    assert sorted(got) == [(0, 30, 2, 7.0), (90, 90, 1, 9.0)]


def test_missing_label_is_the_empty_string(spark):
    df = spark.createDataFrame([("a",), (None,)], "l string")
    assert df.where(all_match([Match("l", "=", "")])).count() == 1
    assert df.where(all_match([Match("l", "!~", "a.*")])).count() == 1


def test_promoted_labels_keep_series_apart(spark):
    df = spark.createDataFrame([({"app": "x", "z": "1"}, 1.0), ({"app": "x", "z": "2"}, 1.0), ({"b": "2", "a": "1"}, 1.0)], "labels map<string,string>, value double")
    out = sorted((r.app, r.other_labels) for r in promote(df, ["app"]).collect())
    assert out == [("", "a=1,b=2"), ("x", "z=1"), ("x", "z=2")]


def test_relabel(spark):
    df = spark.createDataFrame([("true", "pod:9090", "81"), ("false", "pod:9090", "81"), ("true", "pod", "")], "scrape string, addr string, port string")
    rules = [
        {"source_labels": ["scrape"], "action": "keep", "regex": "true"},
        {"source_labels": ["addr", "port"], "action": "replace", "regex": r"([^:]+)(?::\d+)?;(\d+)", "replacement": "$1:$2", "target_label": "addr"},
    ]
    assert [r.addr for r in relabel(df, rules).collect()] == ["pod:81", "pod"]
