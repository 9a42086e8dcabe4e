"""Error detection: which cells are suspect ("dk", don't know) and which are clean."""

from __future__ import annotations

import warnings
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.constraint import OPERATORS, Constraint
from ..sources.tables import INDEX, cells, flatten, whole
from .ordered import before, sides


class Detector(Protocol):
    """Anything with these two methods; both return cells (ind, attr), by position."""

    def noisy_cells(self, df: DataFrame, ind: str = INDEX) -> DataFrame: ...

    def clean_cells(self, df: DataFrame, ind: str = INDEX) -> DataFrame: ...


class _Rest:
    def clean_cells(self, df: DataFrame, ind: str = INDEX) -> DataFrame:
        """Every cell that isn't noisy."""
        return whole(cells(df, ind)).join(self.noisy_cells(df, ind).toDF("ind", "attr"), ["ind", "attr"], "left_anti")


class ConstraintDetector(_Rest):
    """Cells that take part in a violation of any of the constraints."""

    def __init__(self, constraints: list[Constraint]):
        self.constraints = list(constraints)

    def noisy_cells(self, df: DataFrame, ind: str = INDEX) -> DataFrame:
        return reduce(DataFrame.union, [violations(df, c, ind) for c in self.constraints]).distinct()


class NullDetector(_Rest):
    def noisy_cells(self, df: DataFrame, ind: str = INDEX) -> DataFrame:
        return flatten(df, ind).where("val is null").select("ind", "attr")


class RegexDetector(_Rest):
    """Cells of an attribute whose text holds no match of the pattern; with matching=True, those that hold one. Null is neither."""

    def __init__(self, attribute: str, pattern: str, matching: bool = False):
        self.attribute, self.pattern, self.matching = attribute, pattern, matching

    def noisy_cells(self, df: DataFrame, ind: str = INDEX) -> DataFrame:
        hit = F.col(f"`{self.attribute}`").cast("string").rlike(self.pattern)
        return df.where(hit if self.matching else ~hit).select(F.col(f"`{ind}`").alias("ind"), F.lit(self.attribute).alias("attr"))


class LabelledCells(_Rest):
    """Cells given beforehand, as noisy or as clean; the others are the other."""

    def __init__(self, given: DataFrame, clean: bool = False):
        self.given, self.clean = given, clean

    def noisy_cells(self, df: DataFrame, ind: str = INDEX) -> DataFrame:
        given = self.given.toDF("ind", "attr")
        return whole(cells(df, ind)).join(given, ["ind", "attr"], "left_anti" if self.clean else "left_semi")


def violating(df: DataFrame, c: Constraint, name: str, ind: str = INDEX) -> DataFrame:
    """Row numbers that stand for tuple `name` in some violation, each once.

    A dependency needs no self-join: a row violates it if its group has another value. Neither do constraints of two tuples with
    equalities and up to two comparisons, see _by_order. Others are semi-joins, on whatever equalities they have."""
    kind = c.kind()
    if kind == "single":
        return df.alias(name).where(c.column()).select(F.col(f"`{ind}`").alias("ind"))
    if kind == "dependency":
        keys = [p.left.attribute for p in c.predicates if p.operator == "EQ"]
        value = F.col(f"`{next(p.left.attribute for p in c.predicates if p.operator == 'IQ')}`")
        known = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys], value.isNotNull())
        rows = df.where(known)
        split = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")).where("__lo <> __hi")
        return rows.join(split, keys, "left_semi").select(F.col(f"`{ind}`").alias("ind"))
    apart = lambda a, b: F.col(f"`{a}`.`{ind}`") != F.col(f"`{b}`.`{ind}`")
    if len(c.tuples) == 2:
        found = _by_order(df, c, name, ind)
        if found is not None:
            return found
        if kind == "theta":
            warnings.warn(f"no equality joins the tuples of {c.text}: every pair of rows is compared", stacklevel=2)
        other = next(t for t in c.tuples if t != name)
        return (df if kind == "theta" else whole(df)).alias(name).join(df.alias(other), c.column() & apart(name, other), "left_semi").select(F.col(f"`{ind}`").alias("ind"))
    order = [name, *(t for t in c.tuples if t != name)]
    joined, done = df.alias(order[0]), [order[0]]
    rest = list(c.predicates)
    for t in order[1:]:
        done.append(t)
        ready = [p for p in rest if all(r.tuple in done for r in p.refs())]
        rest = [p for p in rest if p not in ready]
        condition = reduce(lambda a, b: a & b, [p.column() for p in ready] + [apart(t, s) for s in done[:-1]])
        joined = joined.join(whole(df).alias(t), condition)
    return joined.select(F.col(f"`{name}`.`{ind}`").alias("ind")).distinct()


def _by_order(df: DataFrame, c: Constraint, name: str, ind: str) -> DataFrame | None:
    """violating() without pairs of rows, or None for constraints that this doesn't cover.

    Does the group of rows that are equal in the keys hold another row that compares? Without a comparison the group's row
    numbers tell; with one the group's extreme value, or the next one where the row holds the extreme itself; an unequal value
    shows in the group's least or greatest; with two comparisons the group is sorted by the first, and the extreme of the second
    among the rows before tells."""
    s = sides(df, c, name)
    if s is None:
        return None
    equal, unequal, compared = s.by("EQ"), s.by("IQ"), s.by("LT", "GT", "LTE", "GTE")
    # No row compares with itself by < or > of an attribute with itself.
    alone = any(x.operator in ("LT", "GT") and x.mine == x.other for x in compared)
    if len(compared) + 2 * len(unequal) > 2 or (len(compared) == 2 and not alone) or any(x.mine != x.other for x in unequal):
        return None
    keys = [f"__k{i}" for i in range(len(equal))] or ["__k"]
    every = lambda xs: reduce(lambda a, b: a & b, xs, F.lit(True))
    me, others = F.col(f"`{ind}`").alias("__me"), F.col(f"`{ind}`").alias("__ind")
    mine = [x.own.alias(k) for k, x in zip(keys, equal)] or [F.lit(0).alias("__k")]
    its = [F.col(f"`{x.other}`").alias(k) for k, x in zip(keys, equal)] or [F.lit(0).alias("__k")]
    known = every([F.col(k).isNotNull() for k in keys])
    probes = lambda *more: df.where(every(s.own)).select(me, *mine, *more).where(known)
    rows = lambda *more: df.where(every(s.other)).select(others, *its, *more).where(known)
    meets = lambda op, a, b: OPERATORS[op][1](a, b)
    out = F.col("__me").alias("ind")
    if not compared and not unequal:
        ends = rows().groupBy(*keys).agg(F.min("__ind").alias("__lo"), F.max("__ind").alias("__hi"))
        return whole(probes()).join(ends, keys).where("__lo <> __me or __hi <> __me").select(out)
    if unequal:
        ends = rows(F.col(f"`{unequal[0].other}`").alias("__y")).groupBy(*keys).agg(F.min("__y").alias("__lo"), F.max("__y").alias("__hi"))
        return whole(probes(unequal[0].own.alias("__v"))).join(ends, keys).where("__lo <> __v or __hi <> __v").select(out)
    other, op, value = compared[-1].other, compared[-1].operator, compared[-1].own
    best = F.max if op in ("GT", "GTE") else F.min
    if len(compared) == 1:
        group = rows(F.col(f"`{other}`").alias("__y")).where("__y is not null")
        tops = group.groupBy(*keys).agg(best(F.struct("__y", "__ind")).alias("__top"))
        joined = whole(probes(value.alias("__v"))).join(tops, keys)
        if alone:
            return joined.where(meets(op, F.col("__top.__y"), F.col("__v"))).select(out)
        held = tops.select(*keys, F.col("__top.__ind").alias("__holder"))
        second = whole(group).join(held, keys).where("__ind <> __holder").groupBy(*keys).agg(best("__y").alias("__next"))
        reached = F.when(F.col("__top.__ind") == F.col("__me"), F.col("__next")).otherwise(F.col("__top.__y"))
        return joined.join(second, keys, "left").where(meets(op, reached, F.col("__v"))).select(out)
    first, first_op, at = compared[0].other, compared[0].operator, compared[0].own
    strict, down = first_op in ("LT", "GT"), first_op in ("GT", "GTE")
    events = rows(F.col(f"`{first}`").alias("__x"), F.col(f"`{other}`").alias("__y")).select(*keys, "__x", F.lit(int(strict)).alias("__kind"), "__y", F.lit(None).cast(df.schema[ind].dataType).alias("__me"))
    asked = probes(at.alias("__x"), value.alias("__v")).select(*keys, "__x", F.lit(int(not strict)).alias("__kind"), F.col("__v"), "__me")
    both = events.withColumn("__v", F.lit(None).cast(df.schema[other].dataType)).unionByName(asked.withColumn("__y", F.lit(None).cast(df.schema[other].dataType))).where("__x is not null")
    x = F.desc("__x") if down else F.asc("__x")
    return before(both, keys, [x, F.asc("__kind")], "__y", best, "__best").where(F.col("__me").isNotNull() & meets(op, F.col("__best"), F.col("__v"))).select(out)


def violations(df: DataFrame, c: Constraint, ind: str = INDEX) -> DataFrame:
    """Cells (ind, attr) that take part in a violation; a tuple that no predicate uses adds none."""
    parts, seen = [], {}
    for name in c.tuples:
        attrs = c.attributes(name)
        if not attrs:
            continue
        # Both tuples of a dependency violate it with the same rows.
        if c.kind() == "dependency" and seen:
            seen["attrs"] = list(dict.fromkeys(seen["attrs"] + attrs))
            continue
        seen = {"rows": violating(df, c, name, ind), "attrs": attrs}
        parts.append(seen)
    made = [p["rows"].select("ind", F.explode(F.array(*map(F.lit, p["attrs"]))).alias("attr")) for p in parts]
    out = reduce(DataFrame.union, made)
    return out.distinct() if len(made) > 1 else out


def detect(df: DataFrame, detectors: list[Detector], ind: str = INDEX) -> tuple[DataFrame, DataFrame]:
    """(clean, dk): dk are the cells that any detector finds noisy, clean those that all find clean."""
    if not detectors:
        raise ValueError("at least one detector is needed")
    dk = reduce(DataFrame.union, [d.noisy_cells(df, ind).toDF("ind", "attr") for d in detectors]).distinct()
    clean = reduce(_in_both, [d.clean_cells(df, ind).toDF("ind", "attr") for d in detectors])
    return clean, dk


def _in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """What DataFrame.intersect gives, by one aggregation: the join that Spark makes of it takes no hint and may broadcast all cells."""
    both = a.withColumn("__in", F.lit(1)).union(b.withColumn("__in", F.lit(2)))
    return both.groupBy("ind", "attr").agg(F.bit_or("__in").alias("__in")).where("__in = 3").drop("__in")
