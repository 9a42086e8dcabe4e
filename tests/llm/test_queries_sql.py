"""Queries that plain SQL can express, against it."""

import pytest

from cellwright.llm import queries

from ..oracle import same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    ok, want, got = same(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.001")
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert ok, [(a, b) for a, b in zip(want[1], got[1]) if a != b][:3]
