"""Queries that SQL can state, against their SQL."""

from __future__ import annotations

import pytest

from assayer.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    result = con.execute(SQL[name])
    order = sorted(range(len(result.description)), key=lambda i: result.description[i][0])
    assert [result.description[i][0] for i in order] == columns
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
