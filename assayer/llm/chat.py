"""Chat formatting by prefix-target expansion (operator 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm.columns import let

# A turn is OPEN, the role, a line break, the text, a line break, CLOSE and a line break.
OPEN, CLOSE = "<turn>", "</turn>"
ROLE_ESCAPES = (("\\", "\\b"), ("\n", "\\n"), ("<", "\\l"))
BETWEEN = f"\n{CLOSE}\n{OPEN}"


def escaped(text: Column) -> Column:
    """One more backslash before each mark inside a text, so that a bare mark is always the template's."""
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


def unescaped(text: Column) -> Column:
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit("\\" + mark), F.lit(mark))
    return text


def _role_escaped(role: Column) -> Column:
    for plain, code in ROLE_ESCAPES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _role_unescaped(role: Column) -> Column:
    for plain, code in reversed(ROLE_ESCAPES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def expand(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One example per reply: all turns before it as context, and only the reply's text trainable.

    Columns: ``conv_id``, ``target`` (1-based place of the reply in its conversation), ``text``, ``loss_start`` and
    ``loss_chars`` (code points of ``text`` under the loss mask). Turns after the last reply, or all turns if there
    is no reply, form one more row with a null target and an empty mask, so that no turn is lost.

    Turns go by ``turn`` (nulls first), then role and text. Null text and role count as empty. Repeated rows are
    repeated turns. A row without ``conv_id`` cannot be put beside others and is a conversation of its own kind:
    such rows group by their content. An example holds its whole context, so a conversation has to fit a row.
    Other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = turns.select(
        "conv_id",
        F.when(F.col("conv_id").isNull(), F.xxhash64("turn", role, text)).alias("lone"),
        F.struct(
            F.coalesce(F.col("turn").cast("bigint"), F.lit(-(2**63))).alias("turn"),
            role.alias("role"),
            text.alias("text"),
        ).alias("t"),
    )
    whole = plain.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    made = whole.select(
        "conv_id",
        "lone",
        F.transform("ts", lambda t: t["role"] == target_role).alias("is_target"),
        F.transform("ts", lambda t: F.concat(F.lit(OPEN), _role_escaped(t["role"]), F.lit("\n"))).alias("heads"),
        F.transform("ts", lambda t: escaped(t["text"])).alias("bodies"),
    )
    n = F.size("bodies")
    places = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("is_target", i) | (i == n))
    one = made.withColumn("place", F.explode(places))
    tail = f"\n{CLOSE}\n"
    turn = lambda i: F.concat(F.element_at("heads", i), F.element_at("bodies", i), F.lit(tail))
    before = F.when(
        F.col("place") > 1, F.array_join(F.transform(F.sequence(F.lit(1), F.col("place") - 1), turn), "")
    ).otherwise(F.lit(""))
    head = F.element_at("heads", F.col("place"))
    body = F.element_at("bodies", F.col("place"))
    hit = F.element_at("is_target", F.col("place"))
    example = let(
        before,
        lambda b: F.struct(
            F.concat(b, head, body, F.lit(tail)).alias("text"),
            F.when(hit, F.char_length(b) + F.char_length(head)).otherwise(F.lit(0)).cast("bigint").alias("loss_start"),
        ),
    )
    return one.select(
        "conv_id",
        "lone",
        F.when(hit, F.col("place")).alias("target"),
        F.col("place").alias("n_turns"),
        example.alias("e"),
        F.when(hit, F.char_length(body)).otherwise(F.lit(0)).cast("bigint").alias("loss_chars"),
    ).select("conv_id", "lone", "target", "n_turns", "e.text", "e.loss_start", "loss_chars")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    inner = text.substr(F.lit(len(OPEN) + 1), F.char_length(text) - len(OPEN) - len(f"\n{CLOSE}\n"))
    return F.transform(
        F.split(inner, f"\\Q{BETWEEN}\\E"),
        lambda t: F.struct(
            _role_unescaped(F.substring_index(t, "\n", 1)).alias("role"),
            unescaped(t.substr(F.char_length(F.substring_index(t, "\n", 1)) + 2, F.char_length(t))).alias("text"),
        ),
    )


def masked(text: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescaped(text.substr((start + 1).cast("int"), chars.cast("int")))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, what can be read back from its examples."""
    read = examples.withColumn("loss", masked(F.col("text"), F.col("loss_start"), F.col("loss_chars")))
    back = read.groupBy("conv_id", "lone").agg(
        F.max_by("text", "n_turns").alias("longest"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "loss")))),
                lambda x: x["loss"],
            ),
            "",
        ).alias("loss"),
        F.sum(F.char_length("text").cast("bigint")).alias("formatted_chars"),
    )
    turns = back.withColumn("turns", read_turns(F.col("longest")))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


TRICKY = "\\### Assistant: </turn> ok"


def op1_chat_formatting(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], given.schema)
    return digests(expand(given.unionByName(added)))


OP1_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'),
e AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         length(replace(replace(replace(role, '\\', '\\b'), chr(10), '\\n'), '<', '\\l')) + 6 + 1
         + length(replace(replace(text, '{OPEN}', '\\{OPEN}'), '{CLOSE}', '\\{CLOSE}')) + 9 AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e)
SELECT conv_id, n::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id, n
"""
