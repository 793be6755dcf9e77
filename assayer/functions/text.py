"""Text predicates and counts, all inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType

# The code points Python's str.split() treats as white space.
WHITESPACE = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD = f"[^{WHITESPACE}]+"
APPROX_TOKEN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def approx_tokens(text: Column) -> Column:
    """Words, digit runs of up to three and punctuation runs. Not a BPE count."""
    return F.regexp_count(text, F.lit(APPROX_TOKEN)).cast("bigint")


# Parts of a text of which a byte-level BPE vocabulary makes tokens one by one: it cuts before white space anyway.
BYTE_LEVEL_PART = re.compile(r"\s*\S+|\s+")
# Signs that are white space to some engines only; a text with one of them is left in one part.
_DOUBTFUL = re.compile("[\x1c-\x1f\u180e\u200b\u2060\ufeff]")
KNOWN_PARTS, KNOWN_CHARS = 1 << 18, 48  # parts whose count a task remembers, and their greatest length


def token_counter(make_encoder: Callable[[], Callable[[str], list]], part: re.Pattern | None = None) -> Callable[[Column], Column]:
    """Arrow-batched token count through a caller-supplied encoder, built once per task.

    With ``part``, a text's count is the sum over its matches, and those of short parts are remembered.
    """

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, known = make_encoder(), {}

        def counted(text: str) -> int:
            if part is None or _DOUBTFUL.search(text):
                return len(encode(text))
            total = 0
            for x in part.findall(text):
                n = known.get(x)
                if n is None:
                    n = len(encode(x))
                    if len(x) <= KNOWN_CHARS:
                        if len(known) >= KNOWN_PARTS:
                            known.clear()
                        known[x] = n
                total += n
            return total

        for texts in batches:
            yield texts.map(lambda t: None if t is None else counted(t)).astype("Int64")

    return count


def contains_terms(text: Column, terms: Column, match: str = "all") -> Column:
    """Case-folded containment of every term (or of any); no terms means true."""
    hit = F.forall if match == "all" else F.exists
    # As a lambda's argument the folded text is made once per row, not once per term.
    found = F.transform(F.array(F.lower(text)), lambda x: hit(terms, lambda t: x.contains(F.lower(t))))
    return F.when(F.coalesce(F.size(terms), F.lit(0)) <= 0, F.lit(True)).otherwise(
        F.coalesce(F.get(found, F.lit(0)), F.lit(False))
    )


def strict_json(text: Column) -> Column:
    """True when the whole text is one JSON value.

    The JSON readers stop at the end of the first value and accept what follows it. The text
    is therefore placed in front of a closing key that depends on the text itself: trailing
    characters keep that key from being read, further members change the count.
    """
    # Bare NaN, Infinity and -Infinity are values to Python's reader; the JVM's takes INF and signs besides. Where such
    # a word occurs, it is read as 0, once the texts in quotes, where it means nothing, are emptied.
    special = F.when(text.rlike("NaN|Infinity"), text)
    emptied = F.regexp_replace(F.regexp_replace(special, r"\\.", ""), '"[^"]*"', '""')
    as_zero = F.regexp_replace(emptied, r"(?<![\w.+-])(?:-?Infinity|NaN)(?![\w.])", "0")
    return _sealed_json(text, False) | (_sealed_json(special, True) & _sealed_json(as_zero, False))


def _sealed_json(text: Column, words: bool) -> Column:
    seal = F.md5(text)
    wrapped = F.concat(F.lit('{"value":'), text, F.lit(',"'), seal, F.lit('":0}'))
    options = {"allowSingleQuotes": "false", "allowNonNumericNumbers": str(words).lower(), "mode": "PERMISSIVE"}
    parsed = F.from_json(wrapped, "map<string,string>", options)
    good = (F.size(parsed) == 2) & F.array_contains(F.map_keys(parsed), seal)
    return F.coalesce(good, F.lit(False))


def normalised(text: Column) -> Column:
    """Lower case, white space runs to one blank, trimmed: the identity of a prompt text."""
    return F.trim(F.regexp_replace(F.lower(text), f"[{WHITESPACE}]+", " "))
