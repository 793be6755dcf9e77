"""Registered queries against the SQL that states their result, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from assayer.plans.catalog import QUERIES

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# Every query is compared; CATALOG_SOME=1 takes this cross-section.
SOME = [
    "run_and_category_summary", "error_list", "category_breakdown_map", "validated_responses", "baseline_comparison",
    "pareto_front", "latency_percentiles_by_run", "judge_scores", "toxicity_regression_alerts", "ab_distribution",
    "platform_stats_by_team", "deduplicated_prompts", "quota_split", "content_digests", "rule_http_error_ratio",
    "rule_team_latency_p95", "harness_platform_overhead", "node_disk", "queue_breaches", "in_flight_requests",
    "service_edges", "missing_attributes", "logs_in_spans", "stream_sliding_requests",
]
NAMES = SOME if os.environ.get("CATALOG_SOME") else [n for n, q in QUERIES.items() if q.sql is not None]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else repr(x)
    return sorted(columns), sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name].build(spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(QUERIES[name].sql)
    want = canonical([d[0] for d in result.description], result.fetchall())
    assert got == want


def test_token_counts_are_the_librarys(spark, con):
    import collections

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tokenizer.encode_special_tokens = True
    want = collections.defaultdict(lambda: [0, 0, 0])
    for source, text in con.execute("SELECT source, text FROM documents").fetchall():
        n = len(tokenizer.encode(text).ids) if text is not None else None
        want[source][0] += 1
        want[source][1] += n or 0
        want[source][2] = max(want[source][2], n or 0)
    got = QUERIES["prompt_token_counts"].build(spark, SF).collect()
    assert {r["source"]: [r["prompts"], r["tokens"], r["longest"]] for r in got} == dict(want)


def test_entry_points(spark):
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
