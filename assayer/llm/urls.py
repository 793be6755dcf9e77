"""URL filters: pattern rules indexed by their rarest literal token (operator 6)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm.columns import LOWER, UPPER, ascii_lower, let, packed, unpacked


@dataclass(frozen=True)
class HostRule:
    """A verdict for a host, all its subdomains and the paths below ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Pattern:
    """A verdict for lower-cased urls in which ``text`` occurs; ``*`` is any run, ``^`` a separator or an end."""

    verdict: str
    text: str

    @property
    def regex(self) -> str:
        parts = {"*": ".*", "^": "(?:^|[^a-z0-9]|$)"}
        return "".join(parts.get(c) or re.escape(c) for c in self.text)

    @property
    def tokens(self) -> list[str]:
        """Runs of letters and digits that every match holds as whole tokens: those with a separator on both sides."""
        found = re.finditer(r"[a-z0-9]+", self.text)
        ends = lambda i: 0 <= i < len(self.text) and self.text[i] != "*"
        return sorted({m[0] for m in found if ends(m.start() - 1) and ends(m.end())})


# The rules of the query's contract.
HOST_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)
PATTERNS = (
    Pattern("block", "^spam-farm^"),
    Pattern("block", "^casino-win^"),
    Pattern("block", "^cheap-pills^"),
    Pattern("block", "^ads-track^"),
    Pattern("block", "^free-bets^"),
    Pattern("block", "^adult-x^"),
    Pattern("block", "^porn*/video^"),
    Pattern("block", "^casino^*^bonus^"),
    Pattern("block", "^wp-login.php^"),
    Pattern("block", "^phpsessid^"),
)
MAX_RULES = 100_000


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.char_length(url)))


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _buckets(entries: Sequence[tuple[str, Column]], kind: str) -> tuple[Column, int]:
    """A literal hash table: entries by key, in as many buckets as there are keys."""
    if len(entries) > MAX_RULES:
        raise ValueError(f"{len(entries)} rules; a literal index holds {MAX_RULES}")
    n = max(1, len({k for k, _ in entries}))
    slots: list[list[Column]] = [[] for _ in range(n)]
    for key, value in entries:
        slots[xxhash.xxh64_intdigest(key.encode(), 42) % n].append(F.struct(F.lit(key).alias("k"), value.alias("v")))
    cell = f"array<struct<k:string,v:{kind}>>"
    return F.array(*[(F.array(*s) if s else F.array()).cast(cell) for s in slots]), n


def _found(index: tuple[Column, int], keys: Column) -> Column:
    """Values of all entries whose key is among ``keys``."""
    table, n = index
    slot = lambda k: F.get(table, _unsigned_mod(F.xxhash64(k), n))
    hits = F.flatten(F.transform(keys, lambda k: F.filter(slot(k), lambda e: e["k"] == k)))
    return F.transform(hits, lambda e: e["v"])


def _unsigned_mod(h: Column, n: int) -> Column:
    """A signed hash as an unsigned number, modulo n."""
    return F.pmod(F.pmod(h, F.lit(n)) + F.when(h < 0, F.lit(2**64 % n)).otherwise(F.lit(0)), F.lit(n)).cast("int")


def token_counts(urls: Column, pages: DataFrame, wanted: Sequence[str]) -> dict[str, int]:
    """How many urls hold each wanted token; at most one row per token reaches the driver."""
    tokens = pages.select(F.explode(F.array_distinct(_tokens(urls))).alias("token"))
    return {r["token"]: r["count"] for r in tokens.where(F.col("token").isin(list(wanted))).groupBy("token").count().collect()}


def _tokens(url: Column) -> Column:
    return F.split(ascii_lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+")


def judge(
    pages: DataFrame,
    host_rules: Sequence[HostRule] = HOST_RULES,
    patterns: Sequence[Pattern] = PATTERNS,
    url: str = "url",
) -> DataFrame:
    """The input with ``host``, ``path``, ``rule``, ``pattern`` and ``verdict``.

    The longest fitting host rule decides. Where none fits, the url's tokens fetch candidate patterns from an index
    keyed by each pattern's rarest token over all urls, and only those run as regular expressions; patterns without
    a sure token run on every url. A pattern that allows beats one that blocks; without any, the url is allowed.

    Every row is judged alone, so repeated rows and hot hosts cost no shuffle. A null url or one without ``://`` has
    an empty host and path; patterns still see its text. The rules are configuration, at most ``MAX_RULES``.
    """
    sure = {p: p.tokens for p in patterns}
    wanted = sorted({t for ts in sure.values() for t in ts})
    counts = token_counts(pages[f"`{url}`"], pages, wanted) if wanted else {}
    keyed = [(min(ts, key=lambda t: (counts.get(t, 0), t)), p) for p, ts in sure.items() if ts]
    value = lambda p: F.struct(F.lit(p.verdict).alias("verdict"), F.lit(p.text).alias("text"), F.lit(p.regex).alias("regex"))
    shape = "struct<verdict:string,text:string,regex:string>"
    index = _buckets([(t, value(p)) for t, p in keyed], shape)
    loose = F.array(*[value(p) for p, ts in sure.items() if not ts]).cast(f"array<{shape}>")
    hosts = _buckets(
        [(r.host, F.struct(F.lit(r.path).alias("path"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))) for r in host_rules],
        "struct<path:string,name:string,verdict:string>",
    )

    named = packed(pages, u=pages[f"`{url}`"]).withColumns({"host": host_of(F.col("u")), "path": path_of(F.col("u"))})

    def parents(labels: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(labels))
        return F.transform(at, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    fitting = F.filter(_found(hosts, let(F.split("host", "\\."), parents)), lambda r: F.startswith(F.col("path"), r["path"]))
    longest = F.array_max(F.transform(fitting, lambda r: F.struct(F.char_length(r["name"]).alias("n"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    low = ascii_lower(F.coalesce(F.col("u"), F.lit("")))
    matching = let(
        low,
        lambda text: F.filter(
            F.concat(loose, _found(index, F.array_distinct(_tokens(text)))), lambda p: F.regexp_like(text, p["regex"])
        ),
    )
    decided = named.withColumn("host_rule", longest).withColumn(
        "hit", F.when(F.col("host_rule").isNull(), F.array_min(matching))
    )
    out = decided.select(
        "row",
        "host",
        "path",
        F.col("host_rule.name").alias("rule"),
        F.col("hit.text").alias("pattern"),
        F.coalesce("host_rule.verdict", "hit.verdict", F.lit("allow")).alias("verdict"),
    )
    return unpacked(out, "host", "path", "rule", "pattern", "verdict")


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


_ANY = "|".join(p.regex for p in PATTERNS)
OP6_SQL = rf"""
WITH p AS (
  SELECT page_id, url, coalesce(substr(url, nullif(instr(url, '://'), 0) + 3), '') AS rest FROM pages),
h AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
         translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(low, '{_ANY}') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
