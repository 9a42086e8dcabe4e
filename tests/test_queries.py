import pytest

from cellwright import queries as core

from .oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    ok, want, got = same(spark, core.queries()[name], core.oracle_sql()[name], SF)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert ok, [(a, b) for a, b in zip(want[1], got[1]) if a != b][:3]


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert core.queries()[name](spark, SF).count() > 0
