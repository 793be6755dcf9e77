"""Quality rules: a threshold table compiled into one projection (operator 4)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm.columns import let, packed, unpacked, words

# Frequent function words of the four languages.
STOP_WORDS = (
    "a and are as at be by for from has in is it not of on or that the this to was were with you",
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une",
    "als auf das dem den der des die ein eine für im in ist mit nicht sich und von zu",
    "al como con de del el en es la las los no para por que se su un una y",
)
SYMBOLS = "#*$%&|<>"
# A stop word counts in lower, upper or title case and with a comma or full stop after it at most.
STOP_FORMS = sorted(
    {form + end for line in STOP_WORDS for w in line.split() for form in (w, w.upper(), w.capitalize()) for end in ("", ",", ".")}
)
PLACE_BITS = 28  # of a window's place in its text


@dataclass(frozen=True)
class Rule:
    """A measure and the closed range in which a document is kept."""

    measure: str
    low: float
    high: float


# The default thresholds. They are wide: a document has to be far from prose to go.
RULES = (
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbols_per_word", 0.0, 0.25),
    Rule("shouts_per_word", 0.0, 0.25),
    Rule("stop_word_share", 0.02, 0.9),
    Rule("repeated_line_share", 0.0, 0.7),
    Rule("marked_line_share", 0.0, 0.9),
)


def repeated_window_words(ws: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found at least twice in the text.

    Numbers of the hash's upper bits and the window's place are sorted; equal neighbours are candidates, and their
    full hashes are sorted again. No step grows with the square of the text.
    """
    at = F.sequence(F.lit(1), F.size(ws) - width + 1)
    hashes = F.when(
        F.size(ws) >= width,
        F.transform(at, lambda i: F.xxhash64(*[F.element_at(ws, i + k) for k in range(width)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        def positions(s: Column) -> Column:
            found = F.filter(s, lambda x, j: _twin(s, j, -1, x["h"], lambda y: y["h"]) | _twin(s, j, 1, x["h"], lambda y: y["h"]))
            every = F.flatten(F.transform(found, lambda x: F.array(*[x["i"] + k for k in range(width)])))
            return F.size(F.array_distinct(every))

        def candidates(s: Column) -> Column:
            top = lambda x: F.shiftright(x, PLACE_BITS)
            found = F.filter(s, lambda x, j: _twin(s, j, -1, top(x), top) | _twin(s, j, 1, top(x), top))
            place = lambda x: x.bitwiseAND(F.lit(2**PLACE_BITS - 1)).cast("int")
            return F.sort_array(F.transform(found, lambda x: F.struct(F.get(h, place(x)).alias("h"), place(x).alias("i"))))

        coded = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-(2**PLACE_BITS))).bitwiseOR(i.cast("bigint")))
        return let(let(F.sort_array(coded), candidates), positions)

    return let(hashes, covered)


def _twin(s: Column, at: Column, step: int, own: Column, part) -> Column:
    """Whether the neighbour in a sorted array has the same part."""
    return F.coalesce(part(F.get(s, at + step)) == own, F.lit(False))


def is_marked(line: Column) -> Column:
    """Whether a line opens with a bullet or ends in an ellipsis."""
    return F.substring(F.ltrim(line), 1, 1).isin("-", "*", "•") | F.right(F.rtrim(line), F.lit(1)).isin("…") | F.endswith(F.rtrim(line), F.lit("..."))


def measures(text: Column) -> Column:
    """All counts and ratios of a text as one struct; null counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def counted(ws: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        n = F.size(ws).cast("bigint")
        chars = F.char_length(F.array_join(ws, "")).cast("bigint")
        symbols = F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("bigint")
        shouts = F.char_length(text) - F.char_length(F.replace(text, F.lit("!"), F.lit("")))
        stops = F.size(F.filter(ws, lambda w: w.isin(STOP_FORMS)))
        per = lambda x, of: F.when(of > 0, x.cast("double") / of).otherwise(F.lit(0.0))

        def with_lines(ls: Column) -> Column:
            repeated = (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint")
            marked = F.size(F.filter(ls, is_marked))
            return F.struct(
                n.alias("n_words"),
                chars.alias("word_chars"),
                symbols.alias("n_symbols"),
                repeated.alias("n_dup_lines"),
                repeated_window_words(ws).cast("bigint").alias("n_repeat_words"),
                per(chars, n).alias("mean_word_chars"),
                per(symbols, n).alias("symbols_per_word"),
                per(shouts, n).alias("shouts_per_word"),
                per(stops, n).alias("stop_word_share"),
                per(repeated, F.size(ls)).alias("repeated_line_share"),
                per(marked, F.size(ls)).alias("marked_line_share"),
            )

        return let(lines, with_lines)

    return let(words(text), counted)


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column, Column]:
    """(base_failed, names of the rules broken, kept) from the measures' struct."""
    base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    broken = F.filter(
        F.array(*[F.when(~m[r.measure].between(r.low, r.high), F.lit(r.measure)) for r in rules]),
        lambda x: x.isNotNull(),
    )
    return base, broken, ~base & (F.size(broken) == 0)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The input with its counts, ``base_failed``, ``broken_rules`` and ``kept``.

    One projection, no shuffle: each row is judged alone, so repeated rows get the same verdict. A null, empty or
    blank text has no words and fails the base. Input columns that bear an output's name are replaced.
    """
    named = packed(docs, m=measures(docs[f"`{text}`"]))
    base, broken, kept = verdict(F.col("m"), rules)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    ratios = list(dict.fromkeys(r.measure for r in rules))
    out = named.select(
        "row",
        *[F.col("m").getField(c).alias(c) for c in dict.fromkeys(counts + ratios)],
        base.alias("base_failed"),
        broken.alias("broken_rules"),
        kept.alias("kept"),
    )
    return unpacked(out, *out.columns[1:])


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Documents that pass, with the input's own columns.

    The verdict is one expression: a filter on several fields would be pushed below the projection and measure the
    text once for each.
    """
    return packed(docs, kept=let(measures(docs["text"]), lambda m: verdict(m, rules)[2])).where("kept").select("row.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_STOPS = ", ".join(f"'{w}'" for w in STOP_FORMS)
OP4_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT *, list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS tri
  FROM w),
pos AS (SELECT doc_id, unnest(tri) AS t, unnest(range(1, len(tri) + 1)) AS i FROM g),
twice AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
          FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM pos) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM twice GROUP BY doc_id),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (length(text) - length(replace(text, '!', '')))::BIGINT AS shouts,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^ *[-*•]|(\.\.\.|…) *$'))) AS marked,
         len(list_filter(ws, lambda x: x IN ({_STOPS}))) AS stops,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM g LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 20.0 AND n_symbols / n_words <= 0.25
       AND shouts / n_words <= 0.25 AND stops / n_words BETWEEN 0.02 AND 0.9
       AND n_dup_lines / n_lines <= 0.7 AND marked / n_lines <= 0.9 AS kept
FROM b
"""
