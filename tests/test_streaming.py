from __future__ import annotations

import datetime
import random

import pandas as pd
from pyspark.sql import functions as F

from assayer.operators import metrics as m, runs
from assayer.streaming import rules, state, windows

NOW = {"availableNow": True}


def stream_of(spark, folder, batches, schema):
    """One file per micro-batch, in order of their names."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/b{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/b*")


def at(seconds):
    return datetime.datetime.fromtimestamp(seconds, datetime.UTC)


def test_gains_wait_for_late_samples(spark, tmp_path):
    schema = "job string, t bigint, value double, ts timestamp"
    stamp = lambda t, v: ("a", t, float(v), at(t))
    batches = [[stamp(100, 10), stamp(120, 14)], [stamp(110, 12), stamp(130, 3)], [stamp(200, 5)], [stamp(400, 6)]]
    stream = stream_of(spark, str(tmp_path / "in"), batches, schema)
    out = state.counter_gains(stream, ["job"], "30 seconds")
    with state.rocksdb(spark):
        windows.to_table(out, str(tmp_path / "out"), str(tmp_path / "cp"), **NOW).awaitTermination(90)
    assert spark.conf.get(state.PROVIDER) != state.ROCKSDB
    rows = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).orderBy("t").collect()
    assert [(r.t, r.gain) for r in rows] == [(110, 2.0), (120, 2.0), (130, 3.0), (200, 2.0)]


class Entry:
    """Stands for a state variable and counts how often the store is asked."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def _do(self, found):
        self.asked += 1
        return found

    def exists(self):
        return self._do(None in self.held)

    def get(self):
        return self._do(self.held[None])

    def update(self, value):
        self._do(self.held.__setitem__(None, value))

    def containsKey(self, key):
        return self._do(key in self.held)

    def getValue(self, key):
        return self._do(self.held[key])

    def updateValue(self, key, value):
        self._do(self.held.__setitem__(key, value))

    def removeKey(self, key):
        self._do(self.held.pop(key))


class Handle:
    def __init__(self):
        self.timers, self.entries = set(), []

    def _new(self, *_):
        self.entries.append(Entry())
        return self.entries[-1]

    getValueState = getMapState = _new

    def registerTimer(self, ms):
        self.timers.add(ms)

    @property
    def asked(self):
        return sum(e.asked for e in self.entries)


def test_a_batch_does_not_touch_what_is_waiting():
    costs = []
    for backlog in (10, 5000):
        gains, handle = state.CounterGains(30), Handle()
        gains.init(handle)
        waiting = pd.DataFrame({"t": range(0, backlog * 30, 15), "value": [float(x) for x in range(2 * backlog)]})
        list(gains.handleInputRows(("hot",), iter([waiting]), None))
        asked = handle.asked
        list(gains.handleInputRows(("hot",), iter([pd.DataFrame({"t": [7], "value": [0.5]})]), None))
        arrival = handle.asked - asked
        expired = type("Info", (), {"getExpiryTimeInMs": lambda self: 30_000})()
        rows = list(gains.handleExpiredTimer(("hot",), None, expired))
        assert rows[0][["from_t", "t", "gain"]].values.tolist() == [[0, 7, 0.5], [7, 15, 0.5]]
        costs.append((arrival, handle.asked - asked))
        assert len(handle.timers) == backlog
    assert costs[0] == costs[1]


class MapEntry(Entry):
    def getValue(self, key):
        return self._do(self.held.get(key))


class TimerHandle(Handle):
    def getMapState(self, *_):
        self.entries.append(MapEntry())
        return self.entries[-1]

    def listTimers(self):
        return iter(self.timers)


def expired_gains(gains, handle, until):
    """Frames that the timers before ``until`` yield, in their order."""
    now = type("Now", (), {"getCurrentWatermarkInMs": lambda self: until})()
    for ms in sorted(x for x in handle.timers if x < until):
        info = type("Info", (), {"getExpiryTimeInMs": lambda self, ms=ms: ms})()
        yield from gains.handleExpiredTimer(("hot", None), now, info)
        handle.timers.discard(ms)


def test_buckets_that_end_together_come_out_in_few_frames(monkeypatch):
    rng = random.Random(7)
    times = [t for t in range(0, 30 * 200, 10) if rng.random() < 0.2]
    samples = pd.DataFrame({"t": times, "value": [float(rng.randrange(50)) for _ in times]})
    found = {}
    for way, untils in {"one by one": range(30_000, 6_000_001, 30_000), "at once": [5_000_000, 6_000_001]}.items():
        gains, handle = state.CounterGains(30), TimerHandle()
        gains.init(handle)
        list(gains.handleInputRows(("hot", None), iter([samples.sample(frac=1, random_state=3)]), None))
        frames = [list(expired_gains(gains, handle, until + 1)) for until in untils]
        found[way] = pd.concat([f for some in frames for f in some], ignore_index=True)
        assert not handle.timers and not gains.waiting.held
        assert way == "one by one" or [len(some) for some in frames] == [1, 1]
    pd.testing.assert_frame_equal(found["one by one"], found["at once"])
    assert len(found["at once"]) == len(times) - 1 and found["at once"]["_k1"].isna().all()
    assert (found["at once"]["ts"].astype("int64") // 10**6 == (found["at once"]["t"] // 30 + 1) * 30_000 - 1).all()
    monkeypatch.setattr(state, "FRAME_ROWS", 20)
    gains, handle = state.CounterGains(30), TimerHandle()
    gains.init(handle)
    list(gains.handleInputRows(("hot", None), iter([samples]), None))
    frames = list(expired_gains(gains, handle, 6_000_001))
    assert max(map(len, frames)) <= 22  # a bucket has three samples at most
    pd.testing.assert_frame_equal(pd.concat(frames, ignore_index=True), found["at once"])


def test_a_bucket_asks_the_store_as_often_however_many_end_with_it():
    asked = {}
    for buckets in (10, 1000):
        gains, handle = state.CounterGains(30), TimerHandle()
        gains.init(handle)
        samples = pd.DataFrame({"t": range(0, buckets * 30, 30), "value": [float(x) for x in range(buckets)]})
        list(gains.handleInputRows(("hot", None), iter([samples]), None))
        before = handle.asked
        frames = list(expired_gains(gains, handle, buckets * 30_000 + 1))
        assert sum(map(len, frames)) == buckets - 1 and len(frames) == 1
        asked[buckets] = handle.asked - before
    # Each is read with the first and removed; its own timer looks for it once more.
    assert asked[1000] - asked[10] == 3 * 990


def test_streamed_rules_over_batches_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(2)
    rows, schema = [], "pod string, le string, t bigint, value double, ts timestamp"
    for pod in "abc":
        value = {"1": 0.0, "+Inf": 0.0}
        for t in range(1000, 4000, 15):
            value["1"] += rng.randrange(3)
            value["+Inf"] = max(value["+Inf"], value["1"]) + rng.randrange(3)
            if rng.random() < 0.01:
                value = {"1": 0.0, "+Inf": 1.0}
            if rng.random() < 0.9:
                rows += [(pod, le, t, x, at(t)) for le, x in value.items()]
    batches = [[r for r in rows if lo <= r[2] < lo + 700] for lo in range(600, 4100, 700)]
    batches[1], moved = batches[1][30:], batches[1][:30]
    batches[2] = moved + batches[2]  # late by one batch, within the delay
    stream = stream_of(spark, str(tmp_path / "in"), batches, schema)
    parts = {"increase": None, "small": F.col("le") == "1"}
    got = rules.windowed_gains(stream, ["pod", "le"], ["le"], 300, 30, "20 minutes", parts)
    with state.rocksdb(spark):
        rules.rule_to_table(got, lambda b: b, str(tmp_path / "out"), str(tmp_path / "cp"), **NOW).awaitTermination(180)
    key = ["le", "eval_t", "increase", "small"]
    streamed = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*key).collect()))
    gains = m.increments(spark.createDataFrame(rows, schema), ["pod", "le"], 30)
    last = max(r[2] for r in rows) - 1200
    batch = m.windowed(gains, ["le"], 300, 30, parts).where(F.col("eval_t") <= last).select(*key)
    assert streamed == sorted(map(tuple, batch.collect())) and len(streamed) > 100


def test_run_state_over_batches(spark, tmp_path):
    schema = "run_id string, seq bigint, status string, done bigint"
    batches = [[("r", 1, "running", 1), ("s", 1, "running", 1)], [("r", 3, "completed", 1), ("r", 2, "running", 1)]]
    stream = stream_of(spark, str(tmp_path / "in"), batches, schema)
    with state.rocksdb(spark):
        windows.updates_to_table(state.run_states(stream), str(tmp_path / "out"), str(tmp_path / "cp"), **NOW).awaitTermination(90)
    rows = runs.newest_state(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert {r.run_id: (r.status, r.done, r.expired) for r in rows} == {"r": ("completed", 3, False), "s": ("running", 1, False)}
    whole = spark.createDataFrame([x for b in batches for x in b], schema)
    assert {(r.run_id, r.status, r.done) for r in runs.latest_status(whole).collect()} == {(r.run_id, r.status, r.done) for r in rows}


def test_ended_runs_are_forgotten_and_can_begin_anew(spark, tmp_path):
    schema = "run_id string, seq bigint, status string, done bigint, ts timestamp"
    batches = [
        [("r", 1, "completed", 2, at(100)), ("s", 1, "running", 1, at(100)), ("late", 1, "failed", 1, at(100))],
        [("late", 2, "running", 1, at(150)), ("x", 1, "running", 1, at(120))],  # reopened before it is forgotten
        [("x", 2, "running", 1, at(1000))],
        [("r", 9, "running", 5, at(1000))],  # begins anew
        [("x", 3, "running", 1, at(1001))],
    ]
    stream = stream_of(spark, str(tmp_path / "in"), batches, schema)
    out = state.run_states(stream, keep_ms=60_000)
    with state.rocksdb(spark):
        windows.updates_to_table(out, str(tmp_path / "out"), str(tmp_path / "cp"), **NOW).awaitTermination(120)
    rows = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("run_id", "seq", "status", "done", "expired").collect()]
    assert ("r", 1, "completed", 2, True) in rows and ("r", 9, "running", 5, False) in rows
    assert ("late", 2, "running", 2, False) in rows
    assert {r[0] for r in rows if r[4]} == {"r"}


def test_late_rows_are_counted(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "timestamp_seconds(1704067200 + id * 86400) AS ts")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    windows.reject_late(stream, now, str(tmp_path / "ok"), str(tmp_path / "no"), str(tmp_path / "cp"), **NOW).awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 8
    assert spark.read.parquet(str(tmp_path / "no")).agg(F.sum("rejected")).first()[0] == 2


class RunEntry(Entry):
    def clear(self):
        self._do(self.held.clear())


class RunHandle(Handle):
    def getValueState(self, *_):
        self.entries.append(RunEntry())
        return self.entries[-1]

    def deleteTimer(self, ms):
        self.timers.discard(ms)


def test_a_part_of_many_runs_asks_the_store_a_few_times(spark):
    ids = [f"r{i}" for i in range(5000)]
    changes = pd.DataFrame({"run_id": ids, "seq": 1, "status": ["failed", "running"] * 2500, "done": 1, "ts_ms": range(5000)})
    states, handle = state.RunState(60_000), RunHandle()
    states.init(handle)
    out = pd.concat(states.handleInputRows((0,), iter([changes]), None))
    assert len(out) == 5000 and handle.asked <= 3 and handle.timers == {60_000}
    at_end = type("Now", (), {"getCurrentWatermarkInMs": lambda self: 62_000})()
    gone = pd.concat(states.handleExpiredTimer((0,), at_end, None))
    assert gone["run_id"].tolist() == ids[:2001:2] and gone["expired"].all()
    assert handle.timers == {60_000, 62_002} and handle.asked <= 6  # the timer that has expired is the store's to drop


def test_a_part_makes_data_frames_of_its_output_only(monkeypatch):
    changes = pd.DataFrame({"run_id": ["a", "b", "a"], "seq": [1, 1, 2], "status": ["running", "failed", "failed"], "done": 1, "ts_ms": [5, 6, 7]})
    later = pd.DataFrame({"run_id": ["b"], "seq": [9], "status": ["running"], "done": [1], "ts_ms": [90_000]})
    made, init = [], pd.DataFrame.__init__
    states, handle = state.RunState(60_000), RunHandle()
    states.init(handle)
    monkeypatch.setattr(pd.DataFrame, "__init__", lambda self, *a, **b: (made.append(1), init(self, *a, **b))[1])
    out = [f for frame in (changes, later) for f in states.handleInputRows((0,), iter([frame]), None)]
    assert len(made) == len(out) == 3
    monkeypatch.undo()
    rows = [tuple(r) for f in out for r in f.values.tolist()]
    assert sorted(rows) == [("a", 2, "failed", 2, False), ("b", 1, "failed", 1, False), ("b", 1, "failed", 1, True), ("b", 9, "running", 1, False)]
    assert handle.timers == {60_007}


def test_changes_without_a_number_an_id_or_a_time():
    columns = ["run_id", "seq", "status", "done", "ts_ms"]
    batches = [
        [("r", None, "failed", 1, 100), (None, 4, "failed", 1, 100), ("r", 3, "running", 1, None)],
        [(None, 2, "running", 1, 110), ("t", 1, "failed", 1, None), ("s", None, "failed", 1, 50)],
    ]
    states, handle = state.RunState(1000), RunHandle()
    states.init(handle)
    shown = {}
    for rows in batches:
        for frame in states.handleInputRows((0,), iter([pd.DataFrame(rows, columns=columns)]), None):
            shown |= {r[0]: tuple(r[1:]) for r in frame.values.tolist()}
    # A change without a number is older than all others, as in ``runs.latest_status``; an ended run without a time stays.
    assert shown == {"r": (3, "running", 2, False), None: (4, "failed", 2, False), "t": (1, "failed", 1, False), "s": (None, "failed", 1, False)}
    assert handle.timers == {1050}
    at_end = type("Now", (), {"getCurrentWatermarkInMs": lambda self: 5000})()
    gone = pd.concat(states.handleExpiredTimer((0,), at_end, None))
    assert gone["run_id"].tolist() == [None, "s"] and gone["expired"].all()


def test_changes_with_one_number_have_one_order(spark):
    schema = "run_id string, seq bigint, status string, done bigint"
    tied = [("r", 1, "failed", 1), ("r", 1, "running", 1), ("r", 1, "completed", 1)]
    for rows in (tied, tied[::-1], tied[1:] + tied[:1]):
        assert [tuple(r) for r in runs.latest_status(spark.createDataFrame(rows, schema).coalesce(1)).collect()] == [("r", "failed", 1, 3)]
        for cut in (1, 2, 3):  # in one batch or several
            states, handle = state.RunState(None), RunHandle()
            states.init(handle)
            for part in filter(None, (rows[:cut], rows[cut:])):
                changes = pd.DataFrame(part, columns=["run_id", "seq", "status", "done"])
                out = pd.concat(states.handleInputRows((0,), iter([changes]), None))
            assert out[["run_id", "seq", "status", "done"]].values.tolist() == [["r", 1, "failed", 3]]


def test_only_gains_of_the_newest_scrape_wait(spark):
    from assayer.plans import metric_standins as ms
    from assayer.plans.catalog import QUERIES

    folder, series = "/root/testdata/sf0.001", ["team", "status"]
    samples = ms.samples(spark, folder, "gateway_requests_total")
    firsts, newest = samples.select(*series).distinct().count(), samples.agg(F.max("t")).first()[0]
    waiting = samples.where(F.col("t") == newest).count()
    assert QUERIES["stream_counter_gains"].build(spark, folder).count() == samples.count() - firsts - waiting
