"""Features of candidates, in long form: (ind, attr, val, feature, value). Absent rows are zeros; nothing is made dense."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.constraint import Constraint, Ref
from ..sources.tables import INDEX, flatten, whole
from .ordered import before, sides

KEY = ["ind", "attr", "val"]


class Featurizer(Protocol):
    """Gives features of a domain (ind, attr, val, observed), and their names with attribute and kind, in order."""

    def features(self, df: DataFrame, domain: DataFrame, ind: str = INDEX) -> DataFrame: ...

    def names(self) -> list[tuple[str, str, str]]: ...


class Observed:
    """1 for the value a cell has."""

    def names(self) -> list[tuple[str, str, str]]:
        return [("Init", "Init", "Init")]

    def features(self, df: DataFrame, domain: DataFrame, ind: str = INDEX) -> DataFrame:
        return domain.where("observed = 1").select(*KEY, F.lit("Init").alias("feature"), F.lit(1.0).alias("value"))


#: Ranges of row numbers in which the rows of a group are counted by themselves.
SHARES = 1024


def row_numbers(df: DataFrame, ind: str = INDEX) -> tuple[int, int] | None:
    """The least and the greatest row number; None if rows aren't numbered by whole numbers, or there are none."""
    if not isinstance(df.schema[ind].dataType, T.IntegralType):
        return None
    low, high = df.agg(F.min(F.col(f"`{ind}`")), F.max(F.col(f"`{ind}`"))).first()
    return None if low is None else (low, high)


class Relaxed:
    """A constraint in which one operand of one predicate is replaced by a cell's candidate.

    All other operands keep their observed values. Of two tuples, the first has the smaller row number, unless the
    replaced predicate compares different attributes: then the rows only differ."""

    def __init__(self, constraint: Constraint, predicate: int, side: str):
        self.constraint, self.predicate, self.side = constraint, constraint.predicates[predicate], side
        self.number = predicate
        self.ref: Ref = getattr(self.predicate, side)
        left, right = self.predicate.left, self.predicate.right
        self.different = isinstance(right, Ref) and left.attribute != right.attribute

    def text(self) -> str:
        swapped = f"{self.ref.tuple}.candidate"
        p = self.predicate
        sides = [swapped if s == self.side else str(getattr(p, s)) for s in ("left", "right")]
        from ..plans.constraint import OPERATORS

        mine = OPERATORS[p.operator][0].join(sides)
        order = [] if len(self.constraint.tuples) != 2 else [f"{self.constraint.tuples[0]}.ind{'<>' if self.different else '<'}{self.constraint.tuples[1]}.ind"]
        return " AND ".join([mine if q is p else str(q) for q in self.constraint.predicates] + order)

    def counts(self, df: DataFrame, domain: DataFrame, ind: str = INDEX, ends: tuple[int, int] | None = None) -> DataFrame:
        """(ind, attr, val, n): with how many rows (or whether, for one tuple) a candidate violates the relaxed constraint.

        ends: the least and the greatest row number, if they are known."""
        name, attribute = self.ref.tuple, self.ref.attribute
        others = [t for t in self.constraint.tuples if t != name]
        events = self.events(0, df, domain, ind, ends or row_numbers(df, ind))
        if events is not None:
            return _counted(*events, ["__r"]).select(*[F.col(f"__cand_{k}").alias(k) for k in KEY], "n")
        given = domain.where(F.col("attr") == attribute).select(*[F.col(k).alias(f"__cand_{k}") for k in KEY])
        swap = F.col("__cand_val").cast(df.schema[attribute].dataType)
        row = whole(df).alias(name).join(given, F.col(f"`{name}`.`{ind}`") == F.col("__cand_ind"))
        conditions = [p.column({self.side: swap} if i == self.number else None) for i, p in enumerate(self.constraint.predicates)]
        if not others:
            return _per_candidate(row.where(_all(conditions)))
        # A tuple is joined on what ties it to those before; the order of two tuples replaces their inequality.
        done = [name]
        for t in others:
            done.append(t)
            apart = [F.col(f"`{s}`.`{ind}`") != F.col(f"`{t}`.`{ind}`") for s in done[:-1]]
            if len(self.constraint.tuples) == 2 and not self.different:
                a, b = (F.col(f"`{x}`.`{ind}`") for x in self.constraint.tuples)
                apart = [a < b]
            ready = [x for x, p in zip(conditions, self.constraint.predicates) if t in (named := {r.tuple for r in p.refs()}) | {name} and named <= set(done)]
            row = row.join(whole(df).alias(t), _all(ready + apart))
        return _per_candidate(row.where(_all(conditions)))

    def events(self, number: int, df: DataFrame, domain: DataFrame, ind: str, ends: tuple[int, int] | None) -> tuple[DataFrame, DataFrame] | None:
        """Candidates and rows of a constraint of two tuples, in one form for all constraints, so that they are counted together: number, keys
        (array of strings) and unequal value, place in an order, share of it. A candidate counts the rows of its keys that come before
        it, less those with its value. None where more than equalities and one inequality tie the tuples."""
        name = self.ref.tuple
        swap = F.col("__cand_val").cast(df.schema[self.ref.attribute].dataType)
        if len(self.constraint.tuples) != 2 or ends is None:
            return None
        s = sides(df, self.constraint, name, (self.number, self.side, swap))
        plain = (T.StringType, T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
        if s is None or len(s.by("IQ", "EQ")) < len(s.across) or len(s.by("IQ")) > 1 or not all(isinstance(df.schema[x.other].dataType, plain) for x in s.across):
            return None
        unequal, equal = s.by("IQ"), s.by("EQ")
        text = lambda columns: F.array(*[c.cast("string") for c in columns]).cast("array<string>")
        its = [F.col(f"`{x.other}`") for x in equal]
        value = unequal[0].own if unequal else F.lit("")
        given = domain.where(F.col("attr") == self.ref.attribute).select(*[F.col(k).alias(f"__cand_{k}") for k in KEY])
        # Does a candidate's own row stand in the group, and with the same value? Where rows only differ, it is taken off again.
        itself = _all([*s.other, *(x.own == y for x, y in zip(equal, its)), *(F.col(f"`{x.other}`").isNotNull() for x in unequal)])
        same = _all([itself, *(x.own == F.col(f"`{x.other}`") for x in unequal)])
        off = lambda c: F.coalesce(c, F.lit(False)).cast("int") if self.different else F.lit(0)
        at = F.col(f"`{ind}`").cast("long")
        share = F.floor((at - ends[0]) / float((ends[1] - ends[0]) // SHARES + 1)).cast("int")
        turn = -1 if self.constraint.tuples[0] == name else 1  # the other tuple's row number is the greater one
        if self.different:  # all rows come first
            asked, told = (F.lit(1).cast("long"), F.lit(SHARES + 2) + share), (F.lit(0).cast("long"), share)
        else:
            asked = told = (at * turn, share * turn)
        probes = whole(df).join(given, F.col(f"`{ind}`") == F.col("__cand_ind")).where(_all(s.own))
        probes = probes.select(F.lit(number).alias("__r"), text([x.own for x in equal]).alias("__k"), value.cast("string").alias("__v"), asked[0].alias("__at"), asked[1].alias("__s"), F.lit(bool(unequal)).alias("__u"), *[F.col(f"__cand_{k}") for k in KEY], off(itself).alias("__in"), off(same).alias("__same"))
        rows = df.where(_all(s.other)).select(F.lit(number).alias("__r"), text(its).alias("__k"), (F.col(f"`{unequal[0].other}`") if unequal else F.lit("")).cast("string").alias("__v"), told[0].alias("__at"), told[1].alias("__s"), F.lit(bool(unequal)).alias("__u"))
        known = F.col("__v").isNotNull() & F.forall("__k", lambda x: x.isNotNull())
        return probes.where(known), rows.where(known)


def _counted(probes: DataFrame, rows: DataFrame, keep: list[str]) -> DataFrame:
    """The candidates of `events` with n, the number of rows that they violate their constraint with, where there are any."""
    both = probes.withColumn("__one", F.lit(0)).unionByName(rows.withColumn("__one", F.lit(1)), allowMissingColumns=True)
    order = [F.asc("__at"), F.asc("__one")]
    both = before(both, ["__r", "__k"], order, "__one", F.sum, "__all", F.col("__s"))
    # Rows go on to the second count only where a value must differ.
    both = before(both.where("__one = 0 or __u"), ["__r", "__k", "__v"], order, "__one", F.sum, "__equal", F.col("__s")).where("__one = 0")
    equal = F.when(F.col("__u"), F.coalesce("__equal", F.lit(0)) - F.col("__same")).otherwise(0)
    n = F.coalesce("__all", F.lit(0)) - F.col("__in") - equal
    return both.select(*keep, *[f"__cand_{k}" for k in KEY], n.cast("long").alias("n")).where("n > 0")


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _per_candidate(hits: DataFrame) -> DataFrame:
    return hits.groupBy(*[F.col(f"__cand_{k}").alias(k) for k in KEY]).agg(F.count("*").alias("n"))


class Violations:
    """How many violations of each relaxed constraint a candidate makes."""

    def __init__(self, constraints: list[Constraint]):
        self.relaxed = [Relaxed(c, i, side) for c in constraints for i, p in enumerate(c.predicates) for side in ("left", "right") if isinstance(getattr(p, side), Ref)]

    def names(self) -> list[tuple[str, str, str]]:
        return [(f"DC{i}", r.ref.attribute, "DC") for i, r in enumerate(self.relaxed, 1)]

    def features(self, df: DataFrame, domain: DataFrame, ind: str = INDEX) -> DataFrame:
        ends = row_numbers(df, ind)
        names = [n for n, _, _ in self.names()]
        events = [r.events(i, df, domain, ind, ends) for i, r in enumerate(self.relaxed)]
        parts = [r.counts(df, domain, ind, ends).select(*KEY, F.lit(n).alias("feature"), F.col("n").cast("double").alias("value")) for r, n, e in zip(self.relaxed, names, events) if e is None]
        together = [e for e in events if e is not None]
        if together:
            found = _counted(reduce(DataFrame.union, [p for p, _ in together]), reduce(DataFrame.union, [r for _, r in together]), ["__r"])
            name = F.element_at(F.array(*map(F.lit, names)), F.col("__r") + 1)
            parts.append(found.select(*[F.col(f"__cand_{k}").alias(k) for k in KEY], name.alias("feature"), F.col("n").cast("double").alias("value")))
        return reduce(DataFrame.union, parts)


class Cooccurrence:
    """For each other dirty attribute of the row, how often the candidate comes with its value; nulls count as values."""

    def __init__(self, dirty: list[str], pairs: DataFrame, values: DataFrame):
        self.dirty, self.pairs, self.values = dirty, pairs, values

    def names(self) -> list[tuple[str, str, str]]:
        return [(f"Cooccur:{a}", a, "Cooccur") for a in self.dirty]

    def features(self, df: DataFrame, domain: DataFrame, ind: str = INDEX) -> DataFrame:
        row = flatten(df, ind, self.dirty).select("ind", F.col("attr").alias("a"), F.col("val").alias("v"))
        near = domain.select(*KEY).join(whole(row), "ind").where("a <> attr")
        pairs = self.pairs.select(F.col("attr").alias("pa"), F.col("val").alias("pv"), F.col("attr2").alias("pb"), F.col("val2").alias("pw"), F.col("n").alias("both"))
        values = self.values.select(F.col("attr").alias("va"), F.col("val").alias("vv"), F.col("n").alias("all"))
        near = near.join(pairs, (F.col("a") == F.col("pa")) & F.col("v").eqNullSafe(F.col("pv")) & (F.col("attr") == F.col("pb")) & (F.col("val") == F.col("pw")))
        near = near.join(values, (F.col("a") == F.col("va")) & F.col("v").eqNullSafe(F.col("vv")))
        return near.select(*KEY, F.concat(F.lit("Cooccur:"), F.col("a")).alias("feature"), (F.col("both") / F.col("all")).alias("value"))


def featurize(df: DataFrame, domain: DataFrame, featurizers: list[Featurizer], ind: str = INDEX) -> DataFrame:
    return reduce(DataFrame.union, [f.features(df, domain, ind) for f in featurizers])


def feature_map(spark, featurizers: list[Featurizer]) -> DataFrame:
    """(feature_ind, feature, attribute, type) in the order of the featurizers."""
    names = [n for f in featurizers for n in f.names()]
    return spark.createDataFrame([(i, *n) for i, n in enumerate(names, 1)], "feature_ind int, feature string, attribute string, type string")


def normalized(features: DataFrame) -> DataFrame:
    """Each candidate's features scaled to length 1."""
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(*KEY)))
    return features.withColumn("value", F.col("value") / F.greatest(length, F.lit(1e-12)))


def dimensions(clean: DataFrame, dk: DataFrame, n_features: int) -> DataFrame:
    """(dimension, length): N training cells, M features, L candidates of the largest domain."""
    both = clean.select("ind", "attr", "val").union(dk.select("ind", "attr", "val"))
    most = both.groupBy("ind", "attr").agg(F.count("*").alias("k")).agg(F.max("k").cast("long").alias("length"))
    n = clean.select("ind", "attr").distinct().agg(F.count("*").alias("length"))
    m = clean.sparkSession.createDataFrame([("M", n_features)], "dimension string, length long")
    return n.select(F.lit("N").alias("dimension"), "length").union(m).union(most.select(F.lit("L").alias("dimension"), "length"))
