from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

TABLES = "documents pages conversations benchmark labels embeddings".split()
SF = "/root/testdata/sf0.001"
WORDS = "the of and la el der die und house river stone light green walks slowly under bright morning water field".split()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def prose(seed: int, n: int) -> str:
    """Invented text of n words, the same for the same seed."""
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing"]) for _ in range(n))


EDGE_ROWS = [
    (1, prose(1, 120), "en"),
    (2, prose(1, 120), "en"),  # an exact copy
    (2, prose(1, 120), "en"),  # a repeated row
    (2, prose(2, 80), "en"),  # a tie: the id again with another text
    (3, "", "en"),
    (4, None, "en"),
    (5, " \t\n ", None),
    (6, "... !!! 123", "de"),
    (None, prose(3, 90), "fr"),
    (None, None, None),
    (7, prose(4, 30_000), None),  # very long
    (8, "x" * 50_000, "en"),  # very long without a space
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with the operators' names."""
    docs = spark.createDataFrame(EDGE_ROWS, "doc_id long, text string, lang string")
    names = ["KEPT", "row", "d", "m", "fp", "label", "Verdict", "n_words", "stay", "ids", "score"]
    return docs.withColumns({n: F.lit(i) for i, n in enumerate(names)})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
