"""Label matchers and relabelling on label columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Match:
    """One matcher; ``op`` is one of = != =~ !~ and regexes match the whole value."""

    label: str
    op: str
    value: str


def matches(m: Match) -> Column:
    """An absent label counts as the empty string."""
    label = F.coalesce(F.col(m.label), F.lit(""))
    if m.op == "=":
        return label == m.value
    if m.op == "!=":
        return label != m.value
    hit = label.rlike(f"^(?:{m.value})$")
    if m.op == "=~":
        return hit
    if m.op == "!~":
        return ~hit
    raise ValueError(f"unknown matcher {m.op}")


def all_match(ms: Iterable[Match]) -> Column:
    out = F.lit(True)
    for m in ms:
        out = out & matches(m)
    return out


def promote(samples: DataFrame, names: Sequence[str], labels: str = "labels", rest: str = "other_labels") -> DataFrame:
    """Turn map labels into columns, so that matchers reach the scan and grouping is exact.

    Labels not named stay together in one canonical text, so distinct series stay distinct.
    """
    left = F.map_filter(F.col(labels), lambda k, _: ~k.isin(*names))
    canonical = F.array_join(
        F.transform(F.array_sort(F.map_entries(left)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    )
    return samples.select(
        *[c for c in samples.columns if c != labels],
        *[F.coalesce(F.try_element_at(F.col(labels), F.lit(n)), F.lit("")).alias(n) for n in names],
        canonical.alias(rest),
    )


def relabel(df: DataFrame, rules: Sequence[Mapping[str, str]], separator: str = ";") -> DataFrame:
    """Scrape-time rules over label columns, in order.

    keep: rows whose joined source labels match the whole regex. replace: on a match the target
    label becomes the replacement with $1, $2 filled in; otherwise it keeps its value.
    """
    for rule in rules:
        source = F.concat_ws(separator, *[F.coalesce(F.col(c), F.lit("")) for c in rule["source_labels"]])
        regex = f"^(?:{rule.get('regex', '(.*)')})$"
        if rule["action"] == "keep":
            df = df.where(source.rlike(regex))
        elif rule["action"] == "replace":
            target = rule["target_label"]
            old = F.col(target) if target in df.columns else F.lit("")
            new = F.regexp_replace(source, regex, rule.get("replacement", "$1"))
            df = df.withColumn(target, F.when(source.rlike(regex), new).otherwise(old))
        else:
            raise ValueError(f"unknown action {rule['action']}")
    return df
