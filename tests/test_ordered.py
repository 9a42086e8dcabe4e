"""Constraints and relaxed constraints without pairs of rows, against all pairs."""

import itertools
import operator
import warnings
from collections import Counter

import numpy as np
import pytest

from cellwright.operators import detect, features
from cellwright.plans.constraint import Literal, parse

OPS = {"EQ": operator.eq, "IQ": operator.ne, "LT": operator.lt, "GT": operator.gt, "LTE": operator.le, "GTE": operator.ge}
COLUMNS = ["__ind", "A", "B", "C", "D"]
CASES = [
    "s&t&EQ(s.A,t.A)",
    "s&t&EQ(s.A,t.B)",
    "s&t&EQ(s.A,t.A)&EQ(s.B,'v1')&EQ(t.C,'v2')",
    "s&t&LT(s.C,t.C)",
    "s&t&LTE(s.C,t.C)",
    "s&t&EQ(s.A,t.A)&GTE(s.C,t.D)",
    "s&t&EQ(s.A,t.A)&GT(s.C,t.D)",
    "s&t&LT(s.C,t.C)&GTE(s.D,t.D)",
    "s&t&GT(s.C,t.C)&LTE(s.B,t.D)",
    "s&t&EQ(s.A,t.A)&LTE(s.C,t.C)&GT(s.D,t.D)",
    "s&t&EQ(s.A,t.A)&LTE(s.C,t.C)&GTE(s.D,t.D)",
    "s&t&EQ(s.A,t.A)&IQ(s.B,t.B)&EQ(s.C,'v1')",
    "s&t&EQ(s.A,t.A)&IQ(s.B,t.C)",
    "s&t&EQ(s.A,t.A)&EQ(s.B,t.C)&IQ(s.D,t.D)",
]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    return [(int(i), *(None if rng.random() < 0.1 else f"v{rng.integers(0, 5)}" for _ in "ABCD")) for i in rng.permutation(60)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "__ind long, A string, B string, C string, D string")


def holds(p, tuples, swap=None):
    def value(side):
        ref = getattr(p, side)
        if swap and swap[0] is p and swap[1] == side:
            return swap[2]
        return ref.value if isinstance(ref, Literal) else tuples[ref.tuple][COLUMNS.index(ref.attribute)]

    a, b = value("left"), value("right")
    return a is not None and b is not None and OPS[p.operator](a, b)


@pytest.mark.parametrize("text", CASES)
def test_violating(table, rows, text):
    c = parse(text, COLUMNS)
    for name in c.tuples:
        other = next(t for t in c.tuples if t != name)
        want = {x[0] for x, y in itertools.permutations(rows, 2) if all(holds(p, {name: x, other: y}) for p in c.predicates)}
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            got = [r[0] for r in detect.violating(table, c, name).collect()]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("text", [CASES[i] for i in (0, 1, 2, 5, 7, 11, 12, 13)])
def test_relaxed_counts(spark, table, rows, text):
    c = parse(text, COLUMNS)
    by = {r[0]: r for r in rows}
    domain = [(i, a, f"v{k}", 0) for i in range(0, 60, 4) for a in "ABCD" for k in (0, 2, 3)]
    given = spark.createDataFrame(domain, "ind long, attr string, val string, observed int")
    for relaxed in features.Violations([c]).relaxed:
        want = Counter()
        name = relaxed.ref.tuple
        other = next(t for t in c.tuples if t != name)
        for i, a, v, _ in domain:
            if a == relaxed.ref.attribute:
                for y in rows:
                    pair = {name: by[i], other: y}
                    first, second = (pair[t][0] for t in c.tuples)
                    if (first != second if relaxed.different else first < second) and all(holds(p, pair, (relaxed.predicate, relaxed.side, v)) for p in c.predicates):
                        want[i, a, v] += 1
        assert Counter({(r.ind, r.attr, r.val): r.n for r in relaxed.counts(table, given).collect()}) == want


def test_three_tuples(spark, table, rows):
    c = parse("s&t&u&EQ(s.A,t.A)&EQ(t.B,u.B)&EQ(u.C,'v1')", COLUMNS)
    given = spark.createDataFrame([(i, "A", "v1", 0) for i in range(0, 60, 7)], "ind long, attr string, val string, observed int")
    relaxed = features.Violations([c]).relaxed[0]
    want = Counter()
    for i in range(0, 60, 7):
        for t, u in itertools.permutations(rows, 2):
            if len({i, t[0], u[0]}) == 3 and t[1] == "v1" and t[2] is not None and t[2] == u[2] and u[3] == "v1":
                want[i, "A", "v1"] += 1
    assert Counter({(r.ind, r.attr, r.val): r.n for r in relaxed.counts(table, given).collect()}) == want
