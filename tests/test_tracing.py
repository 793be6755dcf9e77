from __future__ import annotations

import random

from assayer.operators import tracing

SCHEMA = "trace_id string, span_id string, parent_span_id string, start_us long, end_us long"


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    saved = tracing.saved
    monkeypatch.setattr(tracing, "saved", lambda df, name: rounds.append(name) or saved(df, name))
    rows = [("t", str(i), str(i - 1) if i else None, 0, 10) for i in range(n)] + [("u", "0", None, 0, 10)]
    got = {(r.trace_id, r.span_id): (r.root_span_id, r.depth) for r in tracing.ancestry(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("t", str(i)): ("0", i) for i in range(n)} | {("u", "0"): ("0", 0)}
    assert len(rounds) < 20


def test_broken_links_rings_and_repeated_rows(spark):
    rows = [
        ("t", "a", "gone", 0, 10), ("t", "b", "a", 1, 9),
        ("t", "r1", "r3", 0, 5), ("t", "r2", "r1", 0, 5), ("t", "r3", "r2", 0, 5), ("t", "below", "r2", 0, 5),
        ("t", "self", "self", 0, 5), ("u", "b", None, 0, 4), ("u", "b", None, 0, 4), (None, "x", None, 0, 1), ("u", None, "b", 0, 1),
    ]
    trees = tracing.span_trees(spark.createDataFrame(rows, SCHEMA))
    got = {(r.trace_id, r.span_id): (r.root_span_id, r.depth, r.link) for r in trees.collect()}
    ring = (None, None, "circular")
    assert got == {
        ("t", "a"): ("a", 0, "orphaned"), ("t", "b"): ("a", 1, "orphaned"), ("u", "b"): ("b", 0, "rooted"),
        **{("t", x): ring for x in ("r1", "r2", "r3", "below", "self")},
    }
    assert tracing.span_trees(spark.createDataFrame([], SCHEMA)).count() == 0


def test_time_by_itself_with_many_overlapping_children(spark):
    rng = random.Random(4)
    rows = [("t", "p", None, 100, 5100)]
    for i in range(600):
        a = rng.choice([rng.randrange(0, 5200), 1000])
        rows.append(("t", f"c{i}", "p", a, a + rng.choice([0, 1, 3, 900 if i % 50 == 0 else 4])))
    busy = {x for _, _, p, a, b in rows if p for x in range(max(a, 100), min(b, 5100))}
    for block in (4096, 7):
        got = tracing.covered(spark.createDataFrame(rows, SCHEMA), block).collect()
        assert [(r.span_id, r.children, r.covered_us) for r in got] == [("p", 600, len(busy))]


def test_found_roots_are_not_written_again(spark, monkeypatch):
    written, saved = [], tracing.saved
    monkeypatch.setattr(tracing, "saved", lambda df, name: written.append(df.count()) or saved(df, name))
    rows = [("t", str(i), str(i - 1) if i else None, 0, 10) for i in range(8)] + [("u", f"a{i}", None, 0, 10) for i in range(500)]
    assert tracing.ancestry(spark.createDataFrame(rows, SCHEMA)).count() == 508
    assert sum(written) < 2.2 * 508
