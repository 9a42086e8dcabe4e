"""What comes before a row in its group's order, for groups of any size; and a constraint of two tuples seen from one of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.constraint import Constraint, Literal, Ref
from ..sources.scratch import cut
from ..sources.tables import whole

_TURNED = {"EQ": "EQ", "IQ": "IQ", "LT": "GT", "GT": "LT", "LTE": "GTE", "GTE": "LTE"}


def before(df: DataFrame, keys: list[str], order: list[Column], value: str, how: Callable[[str], Column], name: str, share: Column | None = None) -> DataFrame:
    """df with how(value) (sum, max or min) over the rows of the same keys that come earlier in the order; null if there are none.

    A group may go over any number of tasks: within a share of a group a window runs, and what earlier shares add up to, one
    row for each group and share, is joined. share: numbers that rise with the order; by default all rows are sorted by ranges, and
    shares are the ranges. The rows are written first, as they are read twice."""
    df = df.repartitionByRange(*keys, *order) if share is None else df
    shares = cut(df.withColumn("__share", F.spark_partition_id() if share is None else share), "ordered")
    own = Window.partitionBy(*keys, "__share").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = shares.groupBy(*keys, "__share").agg(how(value).alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__earlier", how("__sum").over(earlier)).drop("__sum")
    both = whole(shares.withColumn("__inner", how(value).over(own))).join(sums, [*keys, "__share"])
    union = F.coalesce(F.col("__inner") + F.col("__earlier"), "__inner", "__earlier") if how is F.sum else F.greatest("__inner", "__earlier") if how is F.max else F.least("__inner", "__earlier")
    return both.withColumn(name, union).drop("__share", "__inner", "__earlier")


@dataclass
class Across:
    """A predicate between the two tuples: other attribute, operator, own operand, which stands for the own attribute `mine`."""

    other: str
    operator: str
    own: Column
    mine: str


@dataclass
class Sides:
    """The predicates of a constraint of two tuples, seen from one: conditions on that tuple alone (own), on the other alone (other), and across."""

    own: list[Column]
    other: list[Column]
    across: list[Across]

    def by(self, *operators: str) -> list[Across]:
        return [x for x in self.across if x.operator in operators]


def sides(df: DataFrame, c: Constraint, name: str, swap: tuple[int, str, Column] | None = None) -> Sides | None:
    """swap: (predicate, "left" or "right", column in place of that operand). None if operands of different types are compared across."""
    out = Sides([], [], [])
    for i, p in enumerate(c.predicates):
        operands = []
        for side, ref in (("left", p.left), ("right", p.right)):
            if isinstance(ref, Literal):
                operands.append((None, F.lit(ref.value), None))
            elif swap and swap[:2] == (i, side):
                operands.append((ref.tuple, swap[2], ref))
            else:
                operands.append((ref.tuple, F.col(f"`{ref.attribute}`"), ref))
        (lt, left, lr), (rt, right, rr) = operands
        tuples = {t for t in (lt, rt) if t}
        if len(tuples) < 2:
            (out.own if tuples == {name} else out.other).append(p.compared(left, right))
            continue
        assert isinstance(lr, Ref) and isinstance(rr, Ref)
        if df.schema[lr.attribute].dataType != df.schema[rr.attribute].dataType:
            return None
        out.across.append(Across(rr.attribute, _TURNED[p.operator], left, lr.attribute) if lt == name else Across(lr.attribute, p.operator, right, rr.attribute))
    return out
