"""Keyed state: counter gains per series and the status of runs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from assayer.operators import runs

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """transformWithState needs the RocksDB state store: start its queries within, the session's own store comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


FRAME_ROWS = 4096  # fixed value: gains from which a data frame is put out


class CounterGains(StatefulProcessor):
    """Gain of each sample over the one before it in the series, in time order.

    Samples wait until the watermark has passed the end of their bucket of time, so out-of-order arrival does not look
    like a restart. A value below its predecessor is a restart from zero. A bucket is one entry of a map with one timer:
    a batch reads and writes the buckets its samples fall into, a timer its own bucket, whatever else is waiting. When
    the watermark has passed several buckets at once, as it does while a stream catches up, the first of their timers
    puts them all out in few data frames, and the others find nothing left.
    """

    def __init__(self, bucket_s: int) -> None:
        self.bucket_s = bucket_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "value double, t bigint")
        self.waiting = handle.getMapState("waiting", "due bigint", "times array<bigint>, held array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list[tuple[int, float]]] = {}
        for pdf in rows:
            for t, value in zip(pdf["t"].astype(int).tolist(), pdf["value"].astype(float).tolist()):
                fresh.setdefault((t // self.bucket_s + 1) * self.bucket_s, []).append((t, value))
        for due, samples in fresh.items():
            times, held = [t for t, _ in samples], [x for _, x in samples]
            if self.waiting.containsKey((due,)):
                before = self.waiting.getValue((due,))
                times, held = [*before[0], *times], [*before[1], *held]
            else:
                self.handle.registerTimer(due * 1000)
            self.waiting.updateValue((due,), (times, held))
        return iter(())

    def _passed(self, due: int, timerValues) -> list[int]:
        """Ends of the series' buckets that the watermark has passed, in order, from the one whose timer has expired."""
        until = due * 1000 if timerValues is None else timerValues.getCurrentWatermarkInMs()
        if until <= (due + self.bucket_s) * 1000:
            return [due]
        return sorted({due, *(ms // 1000 for ms in self.handle.listTimers() if due * 1000 < ms < until)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() // 1000
        found = self.waiting.getValue((due,))
        if found is None:  # it came out with an earlier bucket
            return
        columns = [*(f"_k{i}" for i in range(len(key))), "from_t", "t", "gain", "ts"]
        before = self.last.get() if self.last.exists() else None
        rows = []
        for passed in self._passed(due, timerValues):
            times, held = found if passed == due else self.waiting.getValue((passed,))
            self.waiting.removeKey((passed,))
            # Just before the bucket's end: the watermark of the batch before has not passed it.
            ts = pd.Timestamp(passed * 1000 - 1, unit="ms", tz="UTC")
            for t, value in sorted(zip(times, held)):
                if before is not None:
                    rows.append((*key, int(before[1]), t, value if value < before[0] else value - before[0], ts))
                before = (float(value), int(t))
            if len(rows) >= FRAME_ROWS:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        self.last.update(before)
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    def close(self) -> None:
        pass


def counter_gains(samples: DataFrame, series: Sequence[str], delay: str, ts: str = "ts", bucket_s: int = 30) -> DataFrame:
    """Rows (series, from_t, t, gain, ts) from a stream of counter samples (series, t, value, ts).

    ``ts`` is the end of the sample's bucket less a millisecond, and the event time of operators that follow.
    """
    kinds = dict(samples.dtypes)
    names = [f"_k{i}" for i in range(len(series))]
    fields = [f"{n} {kinds[s]}" for n, s in zip(names, series)] + ["from_t bigint", "t bigint", "gain double", "ts timestamp"]
    out = (
        samples.withWatermark(ts, delay)
        .groupBy(*series)
        .transformWithStateInPandas(
            CounterGains(bucket_s),
            outputStructType=", ".join(fields),
            outputMode="append",
            timeMode="EventTime",
            eventTimeColumnName="ts",
        )
    )
    return out.withColumnsRenamed(dict(zip(names, series)))


# Fixed value: parts that runs are dealt to by a hash of their id. A batch reads and writes the parts its changes fall into.
PARTS = 4096
HELD = {"run_id": "string", "seq": "bigint", "status": "string", "done": "bigint", "last_ms": "bigint", "due_ms": "bigint"}


NEVER = -(2**63)  # stands for the time of a change that has none


class _Run(NamedTuple):
    """What is known of a run: its newest change, the calls it has finished in all, its last time."""

    seq: int | None
    status: str | None
    done: int
    last_ms: int

    def place(self) -> tuple:
        """Order of changes, ties as in ``runs.latest_status``; one without a number is older than any other."""
        return self.seq is not None, self.seq or 0, self.status in runs.FINISHED, self.status or ""

    def with_change(self, change: _Run) -> _Run:
        older, newer = (self, change) if self.place() <= change.place() else (change, self)
        return _Run(
            newer.seq,
            older.status if newer.status is None else newer.status,
            self.done + change.done,
            max(self.last_ms, change.last_ms),
        )

    def ended(self) -> bool:
        return self.status in runs.FINISHED


def _values(column: pd.Series) -> list:
    """A column as a list, None for what is missing; whole numbers that stand as floats beside missing ones are whole again."""
    if column.dtype.kind in "iu":
        return column.tolist()
    of_numbers = column.dtype.kind == "f"
    return [None if x is None or x != x else int(x) if of_numbers else x for x in column.tolist()]


def _shown(found: Iterable[tuple[str | None, _Run]], expired: bool) -> pd.DataFrame:
    rows = [(run_id, run.seq, run.status, run.done, expired) for run_id, run in found]
    return pd.DataFrame(rows, columns=["run_id", "seq", "status", "done", "expired"], dtype=object)


class RunState(StatefulProcessor):
    """Newest status of the runs of one part and how many calls each has finished in all.

    A run that has ended is forgotten ``keep_ms`` of event time after its last change: one more row with ``expired``
    says so. A later change reopens it from nothing. The state is asked a few times for each part and batch, and one
    timer waits for the part's next end. A part has few runs, so they are changed one by one: data frames are made of
    what is put out only.
    """

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        arrays = ", ".join(f"{name} array<{kind}>" for name, kind in HELD.items())
        self.state = handle.getValueState("runs", f"{arrays}, timer_ms bigint")

    def _held(self) -> tuple[dict[str | None, _Run], dict[str | None, int], int]:
        """The part's runs, the times at which those that have ended are due, and the part's timer."""
        if not self.state.exists():
            return {}, {}, 0
        ids, seqs, statuses, done, last_ms, due_ms, timer = self.state.get()
        return dict(zip(ids, map(_Run, seqs, statuses, done, last_ms))), {i: due for i, due in zip(ids, due_ms) if due}, int(timer)

    def _hold(self, held: dict[str | None, _Run], dues: dict[str | None, int], timer: int) -> None:
        due = min(dues.values(), default=0)
        if timer and timer != due:
            self.handle.deleteTimer(timer)
        if due and due != timer:
            self.handle.registerTimer(due)
        if held:
            self.state.update((list(held), *map(list, zip(*held.values())), [dues.get(i, 0) for i in held], due))
        else:
            self.state.clear()

    def _changes(self, rows: Iterable[pd.DataFrame]) -> Iterator[tuple[str | None, _Run]]:
        for pdf in rows:
            ids, seqs, statuses, done = (_values(pdf[name]) for name in ("run_id", "seq", "status", "done"))
            times = [0] * len(pdf) if self.keep_ms is None else (NEVER if x is None else x for x in _values(pdf["ts_ms"]))
            yield from zip(ids, map(_Run, seqs, statuses, (x or 0 for x in done), times))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, dues, timer = self._held()
        now: dict[str | None, _Run] = {}
        anew: dict[str | None, _Run] = {}
        for run_id, change in self._changes(rows):
            due = dues.get(run_id)
            # By its own time a change behind the run's end belongs to a new run.
            if due and change.last_ms >= due:
                anew[run_id] = anew[run_id].with_change(change) if run_id in anew else change
            else:
                before = now.get(run_id) or held.get(run_id)
                now[run_id] = before.with_change(change) if before else change
        closing = {i: now.get(i) or held[i] for i in anew}
        if over := [(i, run) for i, run in closing.items() if run.ended()]:
            yield _shown(over, True)
        now |= {i: change if closing[i].ended() else closing[i].with_change(change) for i, change in anew.items()}
        held |= now
        if self.keep_ms is not None:
            for i, run in now.items():
                dues[i] = run.last_ms + self.keep_ms if run.ended() else 0
        self._hold(held, {i: due for i, due in dues.items() if due > 0}, timer)
        yield _shown(now.items(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, dues, _ = self._held()
        until = timerValues.getCurrentWatermarkInMs()
        over = [(i, held.pop(i)) for i, due in dues.items() if due <= until]
        self._hold(held, {i: due for i, due in dues.items() if i in held}, 0)
        if over:
            yield _shown(over, True)

    def close(self) -> None:
        pass


def run_states(
    changes: DataFrame, keep_ms: int | None = None, delay: str = "0 seconds", ts: str = "ts", parts: int = PARTS
) -> DataFrame:
    """Rows (run_id, seq, status, done, expired) from a stream of changes (run_id, seq, status, done).

    ``done`` of a change counts the calls it finishes; the state adds them up, as ``runs.latest_status`` does in a
    batch. With ``keep_ms``, changes carry the event time ``ts`` and ended runs are forgotten that long after their last
    change by event time, so a finite stream ends; without it, nothing is forgotten. ``parts`` stays as it is for the
    life of a checkpoint.
    """
    if keep_ms is not None:
        changes = changes.withWatermark(ts, delay).withColumn("ts_ms", F.unix_millis(ts))
    dealt = changes.withColumn("part", F.pmod(F.xxhash64("run_id"), F.lit(parts)))
    return dealt.groupBy("part").transformWithStateInPandas(
        RunState(keep_ms),
        outputStructType="run_id string, seq bigint, status string, done bigint, expired boolean",
        outputMode="update",
        timeMode="None" if keep_ms is None else "EventTime",
    )
