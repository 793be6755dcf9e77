"""Licence scans: Dice coefficient over word bigrams against templates (operator 5)."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm.columns import let, packed, unpacked

# Wording of common licence notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
    "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
THRESHOLD = 0.8


def _words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def _bigrams(text: str) -> list[int]:
    """Hashes as ``xxhash64(first, second)`` gives them."""
    ws = _words(text)
    chained = (xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42)) for a, b in zip(ws, ws[1:]))
    return sorted({h - 2**64 if h >= 2**63 else h for h in chained})


def bounds(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Least and most bigrams of a text whose Dice coefficient with a template of ``n`` can reach the threshold."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def normalised(text: Column) -> Column:
    """Lower case; all but letters, digits and line breaks become single spaces."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}\\n]+", " ")


def units(norm: Column) -> Column:
    """What is compared: each line, each paragraph and the whole text."""
    return F.array_distinct(F.concat(F.split(norm, "\n"), F.split(norm, "\n ?(?:\n ?)+"), F.array(norm)))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The input with ``licenses``, ``license``, ``dice`` and ``n_units``.

    ``licenses`` are the templates that some line, paragraph or the whole text reaches, sorted; ``license`` and
    ``dice`` are the best of all, the later name on ties; ``n_units`` counts the units that reach a template. A unit
    is compared only with templates whose size lets the coefficient reach the threshold. Everything is one projection
    over the row, so repeated rows get equal answers; null and empty texts get none. Templates need two words.
    """
    known = [(name, _bigrams(t)) for name, t in templates.items()]
    rows = [
        F.struct(F.lit(name).alias("name"), F.lit(len(b)).alias("n"), *[F.lit(x).alias(k) for k, x in zip(("low", "high"), bounds(len(b), threshold))], F.lit(b).cast("array<bigint>").alias("bigrams"))
        for name, b in known
        if b
    ]
    table = F.array(*rows)
    least, most = min(bounds(len(b), threshold)[0] for _, b in known), max(bounds(len(b), threshold)[1] for _, b in known)

    def best_of(unit: Column) -> Column:
        """Best template of a unit; null if none reaches the threshold."""

        def hashed(ws: Column) -> Column:
            pairs = F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.xxhash64(F.element_at(ws, i), F.element_at(ws, i + 1)))
            return F.when(F.size(ws) > max(1, least), F.array_distinct(pairs))  # else fewer bigrams than any template needs

        def compared(bs: Column) -> Column:
            fitting = F.filter(table, lambda t: F.size(bs).between(t["low"], t["high"]))
            scored = F.transform(
                fitting,
                lambda t: F.struct((2.0 * F.size(F.array_intersect(bs, t["bigrams"])) / (F.size(bs) + t["n"])).alias("dice"), t["name"].alias("name")),
            )
            return F.array_max(F.filter(scored, lambda s: s["dice"] >= threshold))

        ws = F.filter(F.split(unit, "[ \\n]+"), lambda w: w != "")
        return let(let(ws, hashed), lambda bs: F.when(F.size(bs).between(least, most), compared(bs)))

    named = packed(docs, found=F.filter(F.transform(let(normalised(docs[f"`{text}`"]), units), best_of), lambda x: x.isNotNull()))
    top = F.array_max("found")
    out = named.select(
        "row",
        F.array_sort(F.array_distinct(F.transform("found", lambda x: x["name"]))).alias("licenses"),
        top["name"].alias("license"),
        top["dice"].alias("dice"),
        F.size("found").cast("bigint").alias("n_units"),
    )
    return unpacked(out, "licenses", "license", "dice", "n_units")


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", F.array_join("licenses", ",").alias("licenses"), "license", "dice", "n_units")


_ROWS = ", ".join("('{}', '{}')".format(name, " ".join(_words(t))) for name, t in TEMPLATES.items())
OP5_SQL = rf"""
WITH t0(name, norm) AS (VALUES {_ROWS}),
t1 AS (SELECT name, string_split(norm, ' ') AS ws FROM t0),
t AS (SELECT name, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS bs FROM t1),
d AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS norm FROM documents),
u0 AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(norm, chr(10)), list_concat(
         string_split_regex(norm, '\n ?(?:\n ?)+'), [norm])))) AS unit FROM d),
u1 AS (SELECT doc_id, unit, list_filter(string_split_regex(unit, '[ \n]+'), lambda w: w <> '') AS ws FROM u0),
u AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS bs
      FROM u1 WHERE len(ws) > 1),
s AS (SELECT doc_id, unit, name, 2.0 * len(list_intersect(u.bs, t.bs)) / (len(u.bs) + len(t.bs)) AS dice FROM u, t
      WHERE len(u.bs) BETWEEN len(t.bs) / 1.5 AND len(t.bs) * 1.5),
b AS (SELECT doc_id, unit, name, dice::DOUBLE AS dice FROM s WHERE dice >= {THRESHOLD}
      QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, name DESC) = 1),
g AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses,
             arg_max(name, (dice, name)) AS license, max(dice) AS dice, count(*) AS n_units FROM b GROUP BY doc_id)
SELECT doc_id, coalesce(licenses, '') AS licenses, license, dice, coalesce(n_units, 0)::BIGINT AS n_units
FROM documents LEFT JOIN g USING (doc_id)
"""
