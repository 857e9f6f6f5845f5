"""Predicates as values: built, combined, turned into Spark columns, and tested against zone maps."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Compare:
    column: str
    op: str  # = <> < <= > >=
    value: Any


@dataclass(frozen=True)
class In:
    column: str
    values: tuple


@dataclass(frozen=True)
class IsNull:
    column: str


@dataclass(frozen=True)
class IsNotNull:
    column: str


@dataclass(frozen=True)
class And:
    left: Any
    right: Any


@dataclass(frozen=True)
class Or:
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    of: Any


_OPS = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def column(p) -> Column:
    """The predicate as a Spark condition with SQL's three-valued logic. Spark pushes it into Parquet scans."""
    match p:
        case Compare(name, op, value):
            return _OPS[op](F.col(name), F.lit(value))
        case In(name, values):
            return F.col(name).isin(*values)
        case IsNull(name):
            return F.col(name).isNull()
        case IsNotNull(name):
            return F.col(name).isNotNull()
        case And(a, b):
            return column(a) & column(b)
        case Or(a, b):
            return column(a) | column(b)
        case Not(a):
            return ~column(a)
    raise TypeError(p)


def ranges(name: str, parts: list[tuple[Any, bool, Any, bool]]) -> Column:
    """Within one of the ranges (low, with low, high, with high); None: open."""
    c = F.col(name)

    def one(low, with_low, high, with_high):
        tests = []
        if low is not None:
            tests.append(c >= low if with_low else c > low)
        if high is not None:
            tests.append(c <= high if with_high else c < high)
        return reduce(lambda a, b: a & b, tests, c.isNotNull())

    return reduce(lambda a, b: a | b, [one(*p) for p in parts])


def may_match(p) -> Column:
    """Whether a zone with struct columns <name>(min, max, nulls, rows) can hold a row for which p is true.

    Not is only used for null tests; of anything else every zone may match.
    """
    match p:
        case Compare(name, op, value):
            z, v = F.col(name), F.lit(value)
            low, high = z["min"], z["max"]
            test = {"=": (low <= v) & (high >= v), "<>": (low != v) | (high != v), "<": low < v, "<=": low <= v, ">": high > v, ">=": high >= v}[op]
            return F.coalesce(test, F.lit(False))
        case In(name, values):
            return reduce(lambda a, b: a | b, [may_match(Compare(name, "=", v)) for v in values], F.lit(False))
        case IsNull(name) | Not(IsNotNull(name)):
            return F.col(name)["nulls"] > 0
        case IsNotNull(name) | Not(IsNull(name)):
            return F.col(name)["nulls"] < F.col(name)["rows"]
        case And(a, b):
            return may_match(a) & may_match(b)
        case Or(a, b):
            return may_match(a) | may_match(b)
        case Not(_):
            return F.lit(True)
    raise TypeError(p)
