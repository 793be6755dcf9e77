"""Operators that judge each row alone: quality rules, licence scans, URL filters."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from assayer.llm import licenses, quality, urls
from conftest import EDGE_ROWS, prose


def brute_counts(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(ws) - 2):
        at.setdefault(tuple(ws[i : i + 3]), []).append(i)
    hit = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_edges(spark, edges, none):
    out = quality.judge(edges).withColumn("t", F.col("text")).collect()
    assert len(out) == len(EDGE_ROWS)
    for r in out:
        n = brute_counts(r["t"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
    assert {r["doc_id"] for r in out if r["kept"]} >= {1, 2, None}
    assert quality.keep_good(edges).columns == edges.columns
    assert quality.judge(none).count() == 0


def test_quality_rejects_junk(spark):
    base = prose(9, 200)
    texts = {"good": base, "symbols": base.replace(" ", "*** "), "shouts": base.replace(" ", "!! "), "stops": "river " + " ".join(f"w{i}x" for i in range(200))}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "k string, text string")
    kept = {r["k"]: r["broken_rules"] for r in quality.judge(df).collect()}
    want = {"symbols": "symbols_per_word", "shouts": "shouts_per_word", "stops": "stop_word_share"}
    assert kept["good"] == [] and all(rule in kept[k] for k, rule in want.items())


def test_licences(spark, edges, none):
    mit = licenses.TEMPLATES["MIT"]
    wrapped = "Some Project\n\n" + "\n".join(mit[i : i + 60] for i in range(0, len(mit), 60)).replace("of", "of", 1) + "\n\nTail text."
    rows = [(1, mit.upper()), (2, "intro\nLicensed under CC BY-NC 4.0!\nReleased under the MIT License\nend"), (3, prose(1, 50)), (4, mit + prose(2, 200))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: (r["licenses"], r["n_units"]) for r in licenses.scan(df).collect()}
    assert out[1] == (["MIT"], 1) and out[3] == ([], 0) and out[4] == ([], 0)
    assert out[2] == (["CC-BY-NC-4.0-notice", "MIT-notice"], 2)
    split = licenses.scan(spark.createDataFrame([(5, wrapped)], "doc_id long, text string")).first()
    assert split["license"] == "MIT" and 0.8 <= split["dice"] <= 1
    assert licenses.scan(edges).where("n_units > 0").count() == 0 and licenses.scan(none).count() == 0


def test_licence_bounds_are_tight():
    for n in range(1, 200):
        low, high = licenses.bounds(n)
        fits = [m for m in range(1, 400) if 2 * min(m, n) / (m + n) >= licenses.THRESHOLD]
        assert (low, high) == (min(fits), max(fits))


def test_urls(spark):
    cases = {
        "https://a.b.example.net/en/1?x=/": ("a.b.example.net", "/en/1", "example.net/en/", "allow"),
        "HTTP://EXAMPLE.NET/EN/1": ("example.net", "/EN/1", "net/", "block"),
        "http://net": ("net", "", None, "allow"),
        "http://xnet/a": ("xnet", "/a", None, "allow"),
        "http://www.example.com/de/": ("www.example.com", "/de/", "example.com/de/", "block"),
        "ftp://x.org/fr/://y": ("x.org", "/fr/://y", "org/fr/", "allow"),
        "https://m.Spam-Farm.example.com/en/1": ("m.spam-farm.example.com", "/en/1", None, "block"),
        "https://spam-farmer.example.com/en/1": ("spam-farmer.example.com", "/en/1", None, "allow"),
        "https://x.example.com/casino?big#bonus": ("x.example.com", "/casino", None, "block"),
        "no scheme/porn/x": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumn("HOST", F.lit("x")).withColumn("u", F.lit(1))
    out = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert out == cases
    assert urls.judge(df.where("false")).count() == 0


def test_pattern_tokens_and_rarest_index(spark):
    assert urls.Pattern("block", "^ads*track^").tokens == [] and urls.Pattern("block", "x^ads-track^").tokens == ["ads", "track"]
    patterns = [urls.Pattern("block", "^ads^*page^"), urls.Pattern("allow", "^ads^ok^"), urls.Pattern("block", "rack")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(["h://a/ads/page", "h://a/ads/ok/page", "h://a/page", "h://a/xrackx"])], "page_id long, url string")
    found = {r["page_id"]: r["verdict"] for r in urls.judge(df, (), patterns).collect()}
    want = {0: "block", 1: "allow", 2: "allow", 3: "block"}
    assert found == want
    for p in patterns:  # every match holds the pattern's tokens
        for u in ("h://a/ads/page", "h://a/ads/ok/page", "h://a/xrackx"):
            assert not re.search(p.regex, u) or set(p.tokens) <= set(re.split("[^a-z0-9]+", u))
