"""The small worked examples: detection, domains, features, repair, evaluation, wrangler, parser."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwright.config import Config
from cellwright.operators import detect, features, model, repair, wrangle
from cellwright.operators import domain as dom
from cellwright.plans.constraint import ConstraintError, load, parse
from cellwright.sources import tables

RULES = ["t1&t2&EQ(t1.A,t2.A)&IQ(t1.B,t2.B)", "t1&t2&EQ(t1.C,\"f\")&EQ(t2.C,'m')&EQ(t1.E,t2.E)"]
SCHEMA = ["A", "B", "C", "D", "E", "__ind"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [("p", "w", "f", "n", "r", 1), ("p", "z", "f", "k", "r", 2), ("u", "y", "m", "n", "r", 3)]
    return spark.createDataFrame(rows, "A string, B string, C string, D string, E string, __ind long")


@pytest.fixture(scope="module")
def found(table):
    return detect.detect(table, [detect.ConstraintDetector([parse(r, SCHEMA) for r in RULES])])


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_detection(found):
    clean, dk = found
    assert pairs(dk, "attr", "ind") == [("A", 1), ("A", 2), ("B", 1), ("B", 2), ("C", 1), ("C", 2), ("C", 3), ("E", 1), ("E", 2), ("E", 3)]
    assert pairs(clean, "attr", "ind") == [("A", 3), ("B", 3), ("D", 1), ("D", 2), ("D", 3)]


def _domains(table, dk):
    dirty = dom.dirty_attributes(table, dk)
    lookup = dom.cooccurrence(dom.pair_counts(table, dirty), dom.value_counts(table))
    training = tables.cells(table, attrs=dirty).join(dk, ["ind", "attr"], "left_anti")
    return dom.dk_domain(table, dk, lookup), dom.clean_domain(table, training, lookup), dirty


def test_domains(table, found):
    dk, clean, _ = _domains(table, found[1])
    want = {(i, a): v for i in (1, 2) for a, v in (("A", "pu"), ("B", "wyz"), ("C", "fm"), ("E", "r"))} | {(3, "C"): "fm", (3, "E"): "r"}
    assert pairs(dk, "ind", "attr", "val") == sorted((i, a, c) for (i, a), v in want.items() for c in v)
    assert pairs(clean, "ind", "attr", "val") == [(3, "A", "p"), (3, "A", "u"), (3, "B", "w"), (3, "B", "y"), (3, "B", "z")]
    ids = dom.numbered(dk, list("ABCDE"))
    assert [r.vid for r in ids.select("vid").distinct().orderBy("vid").collect()] == list(range(1, 11))


def test_features(table, found):
    dk, _, dirty = _domains(table, found[1])
    signal = features.Violations([parse(r, SCHEMA) for r in RULES])
    got = signal.features(table, dk)
    want = {"DC1": [(1, "p", 1), (1, "u", 1), (2, "u", 1)], "DC2": [(2, "p", 1)], "DC3": [(1, "w", 1), (1, "y", 1)], "DC4": [(2, "y", 1), (2, "z", 1)], "DC5": [(1, "f", 1), (2, "f", 1)], "DC6": [(2, "m", 1), (3, "m", 2)], "DC7": [(1, "r", 1), (2, "r", 1)], "DC8": [(3, "r", 2)]}
    assert pairs(got, "feature", "ind", "val", "value") == sorted((f, *x) for f, v in want.items() for x in v)
    both = features.normalized(features.featurize(table, dk, [features.Observed(), signal, features.Cooccurrence(dirty, dom.pair_counts(table, dirty), dom.value_counts(table))]))
    p = {r.feature: r.value for r in both.where("ind = 1 and attr = 'A' and val = 'p'").collect()}
    assert sorted(round(v, 4) for v in p.values()) == [0.3162, 0.4743, 0.4743, 0.4743, 0.4743]


def test_repair_and_evaluation(spark, table):
    s = repair.Session(spark, Config(learning_iterations=5))
    s.use(table)
    for r in RULES:
        s.add_denial_constraint(r)
    s.detect_errors([detect.ConstraintDetector(s.constraints), detect.NullDetector()])
    out = s.repair()
    assert out.columns == table.columns and out.count() == 3
    assert s.map_values.count() == 10
    truth = tables.flatten(table).toDF("tid", "attr_name", "attr_val")
    m = s.compare_to_truth(truth).first()
    assert m.inferred == 10 and m.total_errors == 0 and m.recall == 1 and m.precision == pytest.approx(m.correct / 10)
    with pytest.raises(IndexError):
        s.remove_denial_constraint(2)
    assert s.remove_denial_constraint(0).text == RULES[0]


def test_session_with_labelled_cells(spark, table, tmp_path, caplog):
    path = str(tmp_path / "cells.csv")
    tables.write_csv(spark.createDataFrame([(1, "B"), (2, "B")], "ind long, attr string"), path)
    s = repair.Session(spark, Config(learning_iterations=1, verbose=True))
    s.use(table)
    assert pairs(s.catalog.get("Map_schema"), "attr_id", "attribute") == list(enumerate("ABCDE", 1))
    clean, dk = s.load_dirty_data(path)
    assert pairs(dk, "ind", "attr") == [(1, "B"), (2, "B")] and clean.count() == 13
    assert s.repair().count() == 3 and {r.attr for r in s.inferred.collect()} == {"B"}
    assert {x for x in ("error detection", "training", "inference") if x in caplog.text} == {"error detection", "training", "inference"}
    clean, dk = s.load_clean_data(path)
    assert pairs(clean, "ind", "attr") == [(1, "B"), (2, "B")] and dk.count() == 13
    s.reset()
    assert not s.catalog.tables and not s.cuts


def test_probabilities_sum_to_one_and_training_learns(spark):
    rng = np.random.default_rng(1)
    domain = [(i, "a", v, int(v == "x")) for i in range(60) for v in "xyz"]
    feats = [(i, "a", v, f, float(rng.random() + (v == "x") * (f == "f1"))) for i in range(60) for v in "xyz" for f in ("f1", "f2")]
    domain = spark.createDataFrame(domain, "ind long, attr string, val string, observed int")
    feats = spark.createDataFrame(feats, "ind long, attr string, val string, feature string, value double")
    config = Config(learning_rate=0.5, weight_decay=0.0, learning_iterations=15, batch_size=10)
    w = model.train(domain, feats, ["f1", "f2"], config)
    assert w[0] > model.initial_weights(["f1", "f2"], config.seed)[0]
    p = model.probabilities(domain, feats, model.weights_frame(spark, ["f1", "f2"], w))
    assert all(abs(r[1] - 1) < 1e-9 for r in p.groupBy("ind").agg(F.sum("probability")).collect())


def test_dependency_equals_self_join(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *(None if rng.random() < 0.1 else f"v{rng.integers(0, 6)}" for _ in range(3))) for i in range(200)]
    df = spark.createDataFrame(rows, "__ind long, A string, B string, C string")
    c = parse("s&t&EQ(s.A,t.A)&EQ(s.B,t.B)&IQ(s.C,t.C)", df.columns)
    assert c.kind() == "dependency"
    want = sorted(a[0] for a in rows if any(None not in a and None not in b and a[1:3] == b[1:3] and a[3] != b[3] for b in rows))
    assert sorted(r[0] for r in detect.violating(df, c, "s").collect()) == want


@pytest.mark.parametrize("text", ["t1&t2", "t1&XX(t1.A,'a')", "t1&EQ(t1.A)", "t1&EQ(t1.A,'a','b')", "t1&fooEQ(t1.A,'a')", "t1&EQ(t1.A,'a'x)", "t1&EQ(t1.A,t2.A)", "t1&EQ(t1.Z,'a')", "t1&EQ('a',t1.A)", "EQ(t1.A,'a')", "t1&EQ(t1.A,'a'"])
def test_parser_refuses(text):
    with pytest.raises(ConstraintError):
        parse(text, SCHEMA)


def test_parser_accepts():
    c = parse("t1&t2&EQ(t1.A,'x&y,(z)')&LTE(t1.B,t2.B)", SCHEMA)
    assert c.predicates[0].right.value == "x&y,(z)" and c.sql() == "t1.A='x&y,(z)' AND t1.B<=t2.B" and c.kind() == "theta"
    assert len(load([RULES[0], "", "  ", RULES[1]], SCHEMA)) == 2
    with pytest.raises(ConstraintError):
        load([RULES[0], RULES[0]], SCHEMA)
    names = "@$#!!!3A@#", "@yy$xasx$21$"
    assert parse(f"{names[0]}&{names[1]}&EQ({names[0]}.A,{names[1]}.A)&GT({names[0]}.B,{names[1]}.B)", SCHEMA).kind() == "equi"


def test_detectors_and_config():
    with pytest.raises(ValueError):
        detect.detect(None, [])
    for bad in ({"pruning_dk_breakoff": 2.5}, {"k_inferred": 0}, {"training_cells": 0}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_wrangler(spark, tmp_path):
    rows = [("Chicago ",), ("chicago",), ("checago",), ("cafcebo",), (None,), ("  'São\n Paulo'",)]
    path = str(tmp_path / "in.csv")
    df = spark.createDataFrame(rows, "city string")
    out = [r[0] for r in wrangle.default_wrangler(["city"]).wrangle(df).collect()]
    assert out == ["chicago", "chicago", "chicago", "cafcebo", "", "sao paulo"]
    tables.write_csv(df.where("city like '%hi%'"), path)
    assert tables.read(spark, path, index=True).columns == ["city", "__ind"]
    with pytest.raises(ValueError):
        wrangle.ColumnNorm("city", wrangle.jaccard)
    with pytest.raises(ValueError):
        tables.read(spark, "x.txt")
