"""What Spark may broadcast by the size of a compressed file: no table's rows or cells, of which the driver would hold the whole."""

import re

import pytest

from cellwright import queries as Q
from cellwright.config import Config
from cellwright.operators import detect, ordered, repair
from cellwright.sources import scratch

SF = "/root/testdata/sf0.001"


def broadcast_scans(df):
    """Parts of the plan that read a file straight into a broadcast; behind a shuffle Spark knows the rows' own size."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(re.match(r"[ :+|*-]*", x)[0]) for x in lines]
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            inside = "\n".join(lines[i:end])
            if "FileScan" in inside and "Exchange hash" not in inside:
                found.append(inside)
    return found


@pytest.fixture
def plans(spark, monkeypatch):
    """The plans of all that is written to the shared folder meanwhile."""
    seen, write = [], scratch.cut
    for module in (repair, ordered):
        monkeypatch.setattr(module, "cut", lambda df, *a: (seen.append(df), write(df, *a))[1])
    return seen


def test_detection_broadcasts_no_cells(spark):
    df = Q.part(spark, SF)
    for out in detect.detect(df, [detect.ConstraintDetector([Q.rule(Q.RULE, df)]), detect.NullDetector()]):
        assert broadcast_scans(out) == []


@pytest.mark.parametrize("weights", [Q.WEIGHTS, None])
def test_session_broadcasts_only_what_is_small(spark, plans, weights):
    session = Q._session(spark, Q.noisy(spark, SF), Config(learning_iterations=1))
    session.add_denial_constraint(Q.RULE)
    session.detect_errors([detect.ConstraintDetector(session.constraints), detect.NullDetector()])
    out = session.repair(weights)
    assert len(plans) > 8
    # Statistics of values, cells drawn and weights are small; rows and cells of the table are not.
    small = r"values-|pairs-|lookup-|drawn-"
    for plan in (*plans, out):
        assert [x for x in broadcast_scans(plan) if not re.search(small, x)] == []
    session.reset()


def test_clean_cells_are_those_all_detectors_find_clean(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "b"), (3, "c", "d")], "__ind long, x string, y string")
    given = spark.createDataFrame([(3, "x"), (1, "y")], "ind long, attr string")
    clean, dk = detect.detect(df, [detect.NullDetector(), detect.LabelledCells(given)])
    assert sorted(map(tuple, clean.collect())) == [(1, "x"), (2, "y"), (3, "y")]
    assert sorted(map(tuple, dk.collect())) == [(1, "y"), (2, "x"), (3, "x")]
