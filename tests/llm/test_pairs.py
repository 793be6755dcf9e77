"""Operators on pairs: near-duplicate lines and documents."""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from assayer.llm import graph, linededup, linehash, simhash
from conftest import EDGE_ROWS


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute_lines(rows, least=linededup.MIN_CHARS):
    """Surviving text of each (doc_id, text), by comparing every line with all earlier ones."""
    earlier, out = [], {}
    for i, text in sorted(rows):
        stay = []
        for line in text.split("\n"):
            x = line.strip().lower()
            if len(line) < least or not any(within_one(x, y) for y in earlier):
                stay.append(line)
            if len(line) >= least:
                earlier.append(x)
        out[i] = "\n".join(stay)
    return out


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(18, 40))) for _ in range(25)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            x = rng.choice(pool)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p = rng.randrange(len(x) + 1)
                x = rng.choice([x[:p] + "Z" + x[p + 1 :], x[:p] + x[p + 1 :], x[:p] + rng.choice("ab") + x[p:]])
            lines.append(x)
        docs.append((i, "\n".join(lines)))
    out = {r["doc_id"]: r["text"] for r in linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == brute_lines(docs)


def test_line_dedup_of_the_given_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    out = {r["doc_id"]: r["text"] for r in linededup.dedup(docs).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    seen, last = set(), {}
    for i, text in sorted(rows):  # equal lines by set, edits by one-deletion sets
        stay = []
        for line in text.split("\n"):
            x = line.strip().lower()
            if len(line) >= linededup.MIN_CHARS:
                cuts = {x[:k] + x[k + 1 :] for k in range(len(x))}
                near = {y for c in {x, *cuts} for y in last.get(c, ())}
                if x in seen or any(within_one(x, y) for y in near):
                    seen.add(x)
                    line = None
                seen.add(x)
                for c in {x, *cuts}:
                    last.setdefault(c, set()).add(x)
            if line is not None:
                stay.append(line)
        assert out[i] == "\n".join(stay)


def test_line_dedup_edges(spark, edges, none):
    out = linededup.dedup(edges)
    rows = out.collect()
    assert len(rows) == len(EDGE_ROWS) and {"n_lines", "n_dropped"} <= set(out.columns)
    assert {r["text"] for r in rows if r["doc_id"] == 4} == {None}
    assert [r["n_dropped"] for r in rows if r["doc_id"] == 1] == [0]
    assert all(r["n_dropped"] == 1 and r["text"] == "" for r in rows if r["doc_id"] == 2 and r["m"] == 3 and r["n_lines"] == 1 and r["text"] == "")
    assert sum(r["n_dropped"] for r in rows) == 2  # both rows of document 2 that repeat document 1
    assert linededup.cleaned(edges).columns == edges.columns
    assert linededup.dedup(none).count() == 0


def test_halves_and_variants_of_lines():
    rng = random.Random(1)
    for _ in range(200):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 12)))
        p = rng.randrange(len(a))
        b = rng.choice([a[:p] + "x" + a[p + 1 :], a[:p] + a[p + 1 :], a[:p] + "b" + a[p:]])
        lines = linehash.Lines([a, b])
        keys = [{int(k[i]) for k in lines.halves()} for i in (0, 1)]
        assert keys[0] & keys[1]
        of, found = lines.without()
        cut = linehash.Lines([a[:i] + a[i + 1 :] for i in range(len(a))])
        assert (found[of == 0] == cut.whole()).all()


def brute_print(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, ids):
    values = np.array(prints, np.uint64)
    group = list(range(len(values)))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4):
            a, b = group[i], group[j]
            if a != b:
                group = [a if g == b else g for g in group]
    known = {g: min((x for x, h in zip(ids, group) if h == g and x is not None), default=None) for g in set(group)}
    return [known[g] for g in group]


def test_fingerprints_against_brute_force():
    for text in [None, "", " a", "a b", "A b c d", "a b c d e É\x1c f", "x" * 50 + " y z w q r s t" * 300]:
        assert simhash.fingerprint(text) == brute_print(text)


def test_every_pair_within_the_radius_collides():
    masks, rng = simhash.covering_masks(), random.Random(2)
    for _ in range(20_000):
        differing = sum(1 << b for b in rng.sample(range(64), simhash.RADIUS))
        assert any(m & differing == 0 for m in masks)


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(20)]
    for _ in range(180):
        x = rng.choice(prints)
        for b in rng.sample(range(64), rng.randrange(1, 6)):
            x ^= 1 << b
        prints.append(x)
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    want = brute_groups(prints, signed)
    for bucket in (4096, 3):  # whole buckets, and buckets cut into pairs of blocks
        links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket=bucket)
        label = {r["node"]: r["label"] for r in graph.components(links).collect()}
        assert [label.get(x, x) for x in signed] == want


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame(path + star + [(7, 7)], "a long, b long")
    label = {r["node"]: r["label"] for r in graph.components(edges).collect()}
    assert label == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert graph.components(edges.where("false")).count() == 0


def test_near_groups_of_the_given_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = simhash.op9_covering_simhash(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    prints = [brute_print(texts[i]) for i in ids]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows}
    assert [got[i] for i in ids] == [(f"{p:016x}", c) for p, c in zip(prints, brute_groups(prints, ids))]


def test_near_groups_edges(spark, edges, none):
    rows = simhash.near_groups(edges).collect()
    assert len(rows) == len(EDGE_ROWS)
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {3}  # empty, blank and null texts are linked
    kept = simhash.keep_one(edges)
    ids = sorted((r["doc_id"] or 0) for r in kept.collect())
    assert kept.columns == edges.columns and ids == [0, 1, 2, 3, 6, 7, 8]
    assert simhash.near_groups(none).count() == 0 and simhash.keep_one(none).count() == 0
    twice = edges.where("doc_id = 1").withColumn("row", F.explode(F.array(F.lit(9), F.lit(3), F.lit(5))))
    assert [r["row"] for r in simhash.keep_one(twice).collect()] == [3]
    lone = edges.where(F.col("doc_id").isNull() & F.col("text").isNotNull())
    assert [r["component_id"] for r in simhash.near_groups(lone).collect()] == [None] and simhash.keep_one(lone).count() == 1


def broadcast_bytes(plan):
    """Measured size of each table that a plan, once run, has broadcast."""
    kind = plan.getClass().getSimpleName()
    if kind == "BroadcastExchangeExec":
        return [plan.metrics().apply("dataSize").value()]
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else None
    children = plan.children()
    below = [children.apply(i) for i in range(children.size())] if below is None else below
    return [x for p in below for x in broadcast_bytes(p)]


LIMIT = 10 << 20  # Spark's own threshold


def test_links_broadcast_no_exploded_table(spark, tmp_path):
    rng = np.random.default_rng(5)
    fps = rng.integers(-(2**63), 2**63 - 1, 20_000)  # 160 KB in a file, 31 rows of each when they meet
    fps = np.concatenate([fps, fps[:50] ^ 5])
    spark.createDataFrame(pd.DataFrame({"fp": fps})).write.parquet(f"{tmp_path}/fps")
    links = simhash.links(spark.read.parquet(f"{tmp_path}/fps"))
    found = {frozenset((r["a"], r["b"])) for r in links.collect()}
    assert found == {frozenset((int(x), int(x ^ 5))) for x in fps[:50]}
    assert all(size <= LIMIT for size in broadcast_bytes(links._jdf.queryExecution().executedPlan()))


def test_groups_broadcast_no_table_of_many_copies(spark):
    many, few = spark.range(300_000).select(F.lit("a copy").alias("text")), spark.range(2_000).select(F.sha2(F.col("id").cast("string"), 256).alias("text"))
    docs = many.union(few).select(F.lit(None).cast("long").alias("doc_id"), "text")  # a few KB in files once fingerprinted
    sizes = simhash.near_groups(docs).groupBy("fp").count().agg(F.count("*"), F.max("count"))
    assert sizes.collect() == [(2_001, 300_000)]
    assert all(size <= LIMIT for size in broadcast_bytes(sizes._jdf.queryExecution().executedPlan()))
