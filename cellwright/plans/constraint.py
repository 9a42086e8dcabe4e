"""Denial constraints: a conjunction of predicates over one or more tuples that no rows may satisfy.

    t1&t2&EQ(t1.zip,t2.zip)&IQ(t1.city,t2.city)&EQ(t1.state,'CA')

Tuple names come first, then predicates OP(tuple.attribute, tuple.attribute or literal). Quotes may be single or double;
a quoted literal may hold any character but its quote."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operator names and what they mean.
OPERATORS: dict[str, tuple[str, Callable[[Column, Column], Column]]] = {
    "EQ": ("=", lambda a, b: a == b),
    "IQ": ("<>", lambda a, b: a != b),
    "LTE": ("<=", lambda a, b: a <= b),
    "GTE": (">=", lambda a, b: a >= b),
    "LT": ("<", lambda a, b: a < b),
    "GT": (">", lambda a, b: a > b),
}


class ConstraintError(ValueError):
    """A constraint that can't be read."""


@dataclass(frozen=True)
class Ref:
    tuple: str
    attribute: str

    def column(self) -> Column:
        return F.col(f"`{self.tuple}`.`{self.attribute}`")

    def __str__(self) -> str:
        return f"{self.tuple}.{self.attribute}"


@dataclass(frozen=True)
class Literal:
    value: str

    def column(self) -> Column:
        return F.lit(self.value)

    def __str__(self) -> str:
        return f"'{self.value}'"


@dataclass(frozen=True)
class Predicate:
    operator: str
    left: Ref
    right: Ref | Literal

    def refs(self) -> list[Ref]:
        return [x for x in (self.left, self.right) if isinstance(x, Ref)]

    def column(self, swap: dict[str, Column] | None = None) -> Column:
        """swap: columns in place of operands, by "left" and "right"."""
        swap = swap or {}
        return self.compared(swap.get("left", self.left.column()), swap.get("right", self.right.column()))

    def compared(self, left: Column, right: Column) -> Column:
        return OPERATORS[self.operator][1](left, right)

    def __str__(self) -> str:
        return f"{self.left}{OPERATORS[self.operator][0]}{self.right}"


@dataclass(frozen=True)
class Constraint:
    text: str
    tuples: tuple[str, ...]
    predicates: tuple[Predicate, ...]

    def attributes(self, name: str) -> list[str]:
        """Attributes that predicates use of a tuple, in order."""
        return list(dict.fromkeys(r.attribute for p in self.predicates for r in p.refs() if r.tuple == name))

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (p.column() for p in self.predicates))

    def sql(self) -> str:
        return " AND ".join(map(str, self.predicates))

    def kind(self) -> str:
        """single, dependency (equal attributes determine one other), equi (some equality joins two tuples) or theta."""
        if len(self.tuples) == 1:
            return "single"
        mirrored = all(isinstance(p.right, Ref) and p.left.attribute == p.right.attribute and p.left.tuple != p.right.tuple for p in self.predicates)
        unequal = [p for p in self.predicates if p.operator == "IQ"]
        if len(self.tuples) == 2 and mirrored and len(unequal) == 1 and len(self.predicates) > 1 and all(p.operator in ("EQ", "IQ") for p in self.predicates):
            return "dependency"
        joins = any(p.operator == "EQ" and isinstance(p.right, Ref) and p.left.tuple != p.right.tuple for p in self.predicates)
        return "equi" if joins else "theta"


def _parts(text: str) -> list[str]:
    """Split at & outside quotes."""
    out, quote, word = [], "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"" and word.rstrip().endswith((",", "(")):
            quote = c
        elif c == "&":
            out.append(word)
            word = ""
            continue
        word += c
    if quote:
        raise ConstraintError(f"a literal without its closing quote: {text}")
    return [*out, word]


def _operand(text: str, tuples: list[str], schema: list[str], whole: str) -> Ref | Literal:
    if text[:1] in ("'", '"') and len(text) > 1:
        if text[-1] != text[0] or text[0] in text[1:-1]:
            raise ConstraintError(f"text follows a quoted literal: {whole}")
        return Literal(text[1:-1])
    names = [n for n in tuples if text.startswith(n + ".")]
    if not names:
        raise ConstraintError(f"{text.partition('.')[0]} is none of the declared tuples: {whole}")
    name = max(names, key=len)
    attribute = text[len(name) + 1 :]
    found = [a for a in schema if a == attribute] or [a for a in schema if a.lower() == attribute.lower()]
    if not found:
        raise ConstraintError(f"the table has no attribute {attribute}: {whole}")
    return Ref(name, found[0])


def _predicate(text: str, tuples: list[str], schema: list[str]) -> Predicate:
    head, bracket, rest = text.partition("(")
    if head not in OPERATORS or not bracket:
        known = re.search("|".join(sorted(OPERATORS, key=len, reverse=True)), text)
        raise ConstraintError(f"a predicate begins with its operator: {text}" if known else f"a predicate without operator: {text}")
    if not rest.endswith(")"):
        raise ConstraintError(f"a predicate ends with its bracket: {text}")
    operands, quote, word = [], "", ""
    for c in rest[:-1]:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"" and not word.strip():
            quote = c
        elif c == ",":
            operands.append(word.strip())
            word = ""
            continue
        elif c in "()":
            raise ConstraintError(f"brackets within a predicate are only for literals in quotes: {text}")
        word += c
    operands.append(word.strip())
    if len(operands) != 2:
        raise ConstraintError(f"a predicate has two operands, not {len(operands)}: {text}")
    left, right = (_operand(x, tuples, schema, text) for x in operands)
    if isinstance(left, Literal):
        raise ConstraintError(f"a literal stands on the right: {text}")
    return Predicate(head, left, right)


def parse(text: str, schema: list[str]) -> Constraint:
    """schema: the attributes of the table, its row number among them."""
    parts = [p.strip() for p in _parts(text.strip())]
    first = next((i for i, p in enumerate(parts) if "(" in p and p.partition("(")[0] in OPERATORS), None)
    if first is None:
        first = next((i for i, p in enumerate(parts) if "(" in p), len(parts))
    tuples = parts[:first]
    if not tuples or not all(tuples) or len(set(tuples)) < len(tuples):
        raise ConstraintError(f"tuples must be declared once each, before the predicates: {text}")
    if first == len(parts):
        raise ConstraintError(f"no predicate: {text}")
    return Constraint(text, tuple(tuples), tuple(_predicate(p, tuples, schema) for p in parts[first:]))


def load(lines: list[str], schema: list[str], known: list[str] | None = None) -> list[Constraint]:
    """Constraints from lines; blank ones are passed over, one that is there already is an error."""
    seen, out = set(known or []), []
    for line in (x.rstrip() for x in lines):
        if line.strip():
            if line in seen:
                raise ConstraintError(f"this constraint is there already: {line}")
            seen.add(line)
            out.append(parse(line, schema))
    return out
