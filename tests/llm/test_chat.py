from __future__ import annotations

import hashlib

from assayer.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(pairs):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in pairs).encode()).hexdigest()


def test_every_reply_is_a_target_once_and_all_is_read_back(spark):
    tricky = ["\\</turn>\n<turn>assistant\nx", "\\\\<turn>", "\n</turn>\n", "</turn></turn>", "\\", "", "a\\\n"]
    turns = [(1, i, r, t) for i, (r, t) in enumerate([(r, t) for t in tricky for r in ("user", "assistant")] + [("sy\\s<\n", "end")])]
    df = spark.createDataFrame(turns, SCHEMA)
    examples = {r["n_turns"]: r for r in chat.expand(df).collect()}
    assert sorted(examples) == [2, 4, 6, 8, 10, 12, 14, 15]
    for n, e in examples.items():
        raw = e["text"][e["loss_start"] : e["loss_start"] + e["loss_chars"]]
        assert raw.replace("\\<turn>", "<turn>").replace("\\</turn>", "</turn>") == (turns[n - 1][3] if n < 15 else "")
        assert e["target"] == (n if n < 15 else None)
        assert max(examples.values(), key=lambda x: x["n_turns"])["text"].startswith(e["text"])
    row = chat.digests(chat.expand(df)).first()
    assert (row["n_turns"], row["turns_sha256"]) == (15, digest([(r, t) for *_, r, t in turns]))
    assert row["loss_sha256"] == hashlib.sha256("".join(tricky).encode()).hexdigest()


def test_edges(spark):
    rows = [
        (1, 0, None, None), (1, None, "user", "first"), (2, 0, "assistant", "only"), (2, 0, "assistant", "only"),
        (None, 0, "user", "lone"), (None, 0, "assistant", "lone"), (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "2 AS ts", "3 AS lone")
    out = sorted((r["conv_id"] or 0, r["n_turns"], r["loss_chars"]) for r in chat.digests(chat.expand(df)).collect())
    assert out == [(0, 1, 0), (0, 1, 0), (0, 1, 4), (1, 2, 0), (2, 2, 8)]
    assert chat.expand(spark.createDataFrame([], SCHEMA)).count() == 0
