"""Signal tables, retention, the span store and sketches."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import datasets, sketches
from assayer.sources import sinks, spanstore

NOW = {"availableNow": True}
SIGNAL = (
    "kind string, ts timestamp, name string, value double, line string, trace_id string, span_id string, parent_span_id string,"
    " end_ts timestamp, resource map<string,string>, attributes map<string,string>"
)


def signal(i: int, kind: str, day: int):
    ts = datetime.datetime(2024, 1, day, 12, tzinfo=datetime.UTC)
    return (kind, ts, f"n{i}", float(i), f"line {i}", "t", str(i), None, ts, {"a": "b"}, {})


def stream_of(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SIGNAL).coalesce(1).write.parquet(f"{folder}/b{i}")
    return spark.readStream.schema(SIGNAL).option("maxFilesPerTrigger", 1).parquet(f"{folder}/b*")


def test_a_stream_killed_between_two_tables_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    batches = [[signal(100 * b + i, kind, 1 + b) for i in range(5) for kind in (*sinks.SIGNAL_COLUMNS, "other")] for b in range(3)]
    stream, path = stream_of(spark, str(tmp_path / "in"), batches), str(tmp_path / "out")
    write, calls = sinks.write_kind, []

    def killed(batch, to, kind, batch_id):
        calls.append((batch_id, kind))
        if (batch_id, kind) == (1, "logs") and calls.count((1, "logs")) == 1:
            raise RuntimeError("killed")
        write(batch, to, kind, batch_id)

    monkeypatch.setattr(sinks, "write_kind", killed)
    enrich = lambda b: b.withColumn("resource", F.map_concat("resource", F.create_map(F.lit("env"), F.lit("test"))))
    with pytest.raises(Exception, match="killed"):
        sinks.fan_out(stream, path, str(tmp_path / "cp"), enrich, **NOW).awaitTermination()
    assert calls.count((1, "metrics")) == 1
    sinks.fan_out(stream, path, str(tmp_path / "cp"), enrich, **NOW).awaitTermination()
    assert calls.count((1, "metrics")) == 2
    for kind in sinks.SIGNAL_COLUMNS:
        rows = spark.read.parquet(f"{path}/{kind}").collect()
        ids = sorted(r["line"] if kind == "logs" else r["name"] for r in rows)
        assert ids == sorted((f"line {100 * b + i}" if kind == "logs" else f"n{100 * b + i}") for b in range(3) for i in range(5))
        assert all(r["resource"] == {"a": "b", "env": "test"} for r in rows)


def test_expired_dates_go_while_a_reader_is_open(spark, tmp_path):
    path = str(tmp_path)
    rows = [signal(d, kind, d) for d in range(1, 31) for kind in sinks.SIGNAL_COLUMNS]
    rows.append(("logs", None, *signal(0, "logs", 1)[2:]))
    for kind in sinks.SIGNAL_COLUMNS:
        sinks.write_kind(spark.createDataFrame(rows, SIGNAL), path, kind, 0)
    today = datetime.date(2024, 1, 30)
    yesterday = F.lit("2024-01-29 12:00:00")
    readers = {k: sinks.retained(spark.read.parquet(f"{path}/{k}"), yesterday, d) for k, d in sinks.RETENTION_DAYS.items()}
    gone = sinks.drop_expired(spark, path, today)
    assert len(gone) == 13 + 21 + 26 and "logs/date=2024-01-21" in gone and "logs/date=2024-01-22" not in gone
    for kind, days in sinks.RETENTION_DAYS.items():
        assert readers[kind].count() == days + 2  # opened a day ago, read to its end
        left = spark.read.parquet(f"{path}/{kind}")
        assert left.agg(F.min("date")).first()[0] == today - datetime.timedelta(days=days + 1)
    assert spark.read.parquet(f"{path}/logs").where("date IS NULL").count() == 1
    assert sinks.drop_expired(spark, path, today) == []


def scanned(df) -> int:
    """Rows that the file scan hands on, after it has left out row groups."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_searches_reach_the_files(spark, tmp_path):
    rng = random.Random(1)
    n = 20_000
    rows = [
        (f"{rng.getrandbits(64):016x}", f"{rng.getrandbits(64):016x}", 1704067200 + i % 172800,
         {"service.name": f"s{i % 3}", "k": "v"}, {"lab.run.id": f"run-{rng.getrandbits(32)}", "odd": str(i % 5)})
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, s long, resource map<string,string>, attributes map<string,string>")
    path = str(tmp_path / "store")
    with_small_groups = df.coalesce(1)
    spanstore.write_spans(with_small_groups, path, F.timestamp_seconds("s"), row_group_bytes=60_000)
    store = spark.read.parquet(path)
    assert store.count() == n
    trace, span, _, _, attributes = rows[n // 2]
    for found in (
        spanstore.find(store, trace_id=trace),
        spanstore.find(store, span_id=span),
        spanstore.find(store, attributes={"lab.run.id": attributes["lab.run.id"]}),
    ):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(" in plan and "EqualTo(" in plan
        assert [r["span_id"] for r in found.collect()] == [span]
        assert scanned(found) < n / 4
    by_map = spanstore.find(store, {"service.name": "s1"}, {"odd": "2"}, ("2024-01-02", "2024-01-02"))
    assert "PartitionFilters: [isnotnull(date" in by_map._jdf.queryExecution().executedPlan().toString()
    want = sum(r[2] >= 1704153600 and r[3]["service.name"] == "s1" and r[4]["odd"] == "2" for r in rows)
    assert by_map.count() == want


def test_sketched_guard_flags_what_the_exact_one_flags(spark, tmp_path):
    rng = random.Random(3)
    sizes = {None: 990, "a": 1000, "b": 1001, "c": 1500, "d": 700, "e": 0, "f": 20_000}
    rows = [(k, rng.randrange(4), f"{k}-{i}") for k, n in sizes.items() for i in range(n) for _ in range(2)] + [("e", 1, None)]
    df = spark.createDataFrame(rows, "team string, day int, id string")
    path = str(tmp_path / "ids")
    sketches.write_by_day(sketches.daily_distinct(df, ["team"], "id"), path)
    sketches.write_by_day(sketches.daily_distinct(df.where("day = 2"), ["team"], "id"), path)  # a day again
    stored = spark.read.parquet(path)
    got = {r["team"]: r for r in sketches.sketched_guard(df, stored, ["team"], "id", 1000).collect()}
    exact = {r["team"]: r for r in datasets.cardinality_guard(df, ["team"], "id", 1000).collect()}
    assert {t: r["over_limit"] for t, r in got.items()} == {t: r["over_limit"] for t, r in exact.items()}
    assert got["d"]["distinct_ids"] is None and got["b"]["distinct_ids"] == 1001
    for team, n in sizes.items():
        assert abs(got[team]["estimate"] - n) <= sketches.MARGIN * n


def test_sketches_of_a_day_are_one_file_and_read_once(spark, tmp_path):
    df = spark.range(6000).selectExpr("concat('r', id % 60) AS run", "CAST(id % 25 AS INT) AS day", "CAST(id AS STRING) AS id")
    daily = sketches.daily_distinct(df, ["run"], "id").localCheckpoint()
    path = str(tmp_path / "ids")
    sketches.write_by_day(daily.repartition(4, "run"), path)
    files = [sum(f.suffix == ".parquet" for f in day.iterdir()) for day in (tmp_path / "ids").glob("day=*")]
    assert files == [1] * 25  # not one for each task and day
    stored = spark.read.parquet(path)
    assert stored.count() == daily.count() == 300
    found = sketches.sketched_guard(df, stored, ["run"], "id", 80)
    assert not [f for f in found.inputFiles() if "/ids/" in f]
    assert {(r["distinct_ids"], r["over_limit"]) for r in found.collect()} == {(100, True)} and found.count() == 60


def test_a_hot_day_of_sketches_is_divided(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    day = "CAST(IF(id % 50 = 0, id % 7, 9) AS INT) AS day"
    df = spark.range(0, 40_000, 1, 4).selectExpr("concat('r', id) AS run", day, "sha2(CAST(id AS STRING), 256) AS ids")
    spark.conf.set(size, "64k")
    try:
        sketches.write_by_day(df, str(tmp_path / "ids"))
    finally:
        spark.conf.set(size, before)
    files = {day.name: sum(f.suffix == ".parquet" for f in day.iterdir()) for day in (tmp_path / "ids").glob("day=*")}
    assert files["day=9"] > 1 and len(files) == 8
    assert spark.read.parquet(str(tmp_path / "ids")).count() == 40_000


def test_quantile_sketches_merge_within_their_bound(spark, tmp_path):
    points = {"p1": 10, "p50": 500, "p95": 950, "p99": 990}
    df = spark.range(60_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id % 5) END AS team", "CAST(id % 7 AS INT) AS day",
        "CAST(CASE WHEN id % 11 = 0 THEN 500 ELSE pow(id % 1013, 2) END AS BIGINT) AS us",
    ).unionByName(spark.createDataFrame([("none", 1, None), (None, 1, 5)], "team string, day int, us bigint"))
    path = str(tmp_path / "latency")
    sketches.write_by_day(sketches.daily_quantiles(df, ["team"], F.col("us")), path)
    merged = sketches.sketch_percentiles(sketches.merged_quantiles(spark.read.parquet(path), ["team"]), ["team"], points)
    whole = sketches.merged_quantiles(sketches.daily_quantiles(df.withColumn("day", F.lit(0)), ["team"], F.col("us")), ["team"])
    for found in (merged, sketches.sketch_percentiles(whole, ["team"], points)):
        errors = sketches.rank_errors(df, found, ["team"], F.col("us"), points).collect()
        assert {r["team"] for r in errors} == {"hot", "t0", "t1", "t2", "t3", "t4", None}
        for r in errors:
            assert r["n"] == r["rows"]
            assert all(r[p] <= sketches.RANK_ERROR for p in points)
    assert sketches.sketch_percentiles(sketches.merged_quantiles(spark.read.parquet(path).where("false"), ["team"]), ["team"], points).count() == 0
