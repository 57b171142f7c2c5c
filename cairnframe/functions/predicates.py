"""Predicates: a column against a literal, and their combinations.

A predicate is null-strict: it is null as soon as a column that it compares, tests for membership or parity is null, also inside
`and_` and `or_`. Filters keep rows where it is true. So keeping means: every such column is non-null, and the plain predicate holds,
which Catalyst can push into a scan.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FrameError, TypeMismatch, UnknownColumn
from ..types import Kind, Schema
from .text import value_text

_INTEGER = re.compile(r"[+-]?[0-9]+")
_FLOAT = re.compile(r"[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|inf|infinity|nan)", re.I)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _coerce(value, kind: Kind, column: str):
    """The literal as a value of the column's kind; only listed conversions are made."""
    whole = isinstance(value, int) and not isinstance(value, bool)
    if kind is Kind.INT:
        if isinstance(value, float):
            if not math.isfinite(value):
                raise TypeMismatch(f"literal {value} is no integer, for int64 column {column}")
            value, whole = math.trunc(value), True
        elif isinstance(value, str) and _INTEGER.fullmatch(value):
            value, whole = int(value), True
        if whole and -(2**63) <= value < 2**63:
            return value
    elif kind is Kind.FLOAT:
        if whole or isinstance(value, float):
            return float(value)
        if isinstance(value, str) and _FLOAT.fullmatch(value):
            return float(value)
    elif kind is Kind.BOOL:
        if isinstance(value, bool):
            return value
    elif kind is Kind.UTF8:
        return "<nil>" if value is None else value_text(value)
    else:
        raise TypeMismatch(f"column {column} can't be compared")
    raise TypeMismatch(f"literal {value!r} doesn't fit column {column}")


class Expr:
    """Base of predicates."""

    def columns(self) -> list[str]:
        """Names, each once, in order."""
        return list(dict.fromkeys(self._names()))

    def _names(self):
        raise NotImplementedError

    def _valued(self) -> list[str]:
        """Columns whose nulls make the predicate null."""
        return self._names()

    def _plain(self, schema: Schema) -> Column:
        raise NotImplementedError

    def check(self, schema: Schema) -> None:
        for c in self.columns():
            if schema.lookup(c) is None:
                raise UnknownColumn(f"unknown column {c!r}")

    def keep(self, schema: Schema) -> Column:
        """True for the rows that a filter keeps, never null."""
        self.check(schema)
        out = None
        for c in dict.fromkeys(self._valued()):
            out = quoted(c).isNotNull() if out is None else out & quoted(c).isNotNull()
        plain = self._plain(schema)
        return plain if out is None else out & plain

    def __and__(self, other: Expr) -> Expr:
        return and_(self, other)

    def __or__(self, other: Expr) -> Expr:
        return or_(self, other)

    def __invert__(self) -> Expr:
        return not_(self)


@dataclass(frozen=True)
class Compare(Expr):
    column: str
    op: str
    value: object

    def _names(self):
        return [self.column]

    def _plain(self, schema):
        kind = schema.lookup(self.column).dtype.kind
        value, c = _coerce(self.value, kind, self.column), quoted(self.column)
        if kind is Kind.BOOL and self.op not in ("==", "!="):
            return F.lit(False)
        if kind is Kind.FLOAT and math.isnan(value):
            return F.lit(self.op == "!=")
        out = {"==": c == value, "!=": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[self.op]
        # Spark orders NaN above all numbers; here it is unequal to everything and in no order.
        return out & ~F.isnan(c) if kind is Kind.FLOAT and self.op in ("==", ">", ">=") else out


@dataclass(frozen=True)
class Even(Expr):
    column: str

    def _names(self):
        return [self.column]

    def _plain(self, schema):
        kind, c = schema.lookup(self.column).dtype.kind, quoted(self.column)
        if kind is Kind.INT:
            return c % 2 == 0
        if kind is Kind.FLOAT:
            return F.coalesce(c.try_cast("long") % 2 == 0, F.lit(False))
        if kind is Kind.UTF8:
            return F.octet_length(c) % 2 == 0
        if kind is Kind.BOOL:
            return ~c
        raise TypeMismatch(f"column {self.column} has no parity")


@dataclass(frozen=True)
class Null(Expr):
    column: str
    is_null: bool

    def _names(self):
        return [self.column]

    def _valued(self):
        return []

    def _plain(self, schema):
        return quoted(self.column).isNull() if self.is_null else quoted(self.column).isNotNull()


@dataclass(frozen=True)
class In(Expr):
    column: str
    values: tuple

    def _names(self):
        return [self.column]

    def _plain(self, schema):
        kind = schema.lookup(self.column).dtype.kind
        if not self.values:
            return F.lit(False)
        if kind not in (Kind.INT, Kind.BOOL, Kind.UTF8):
            raise TypeMismatch(f"membership isn't supported for column {self.column}")
        return quoted(self.column).isin([_coerce(v, kind, self.column) for v in self.values])


@dataclass(frozen=True)
class Not(Expr):
    inner: Expr

    def _names(self):
        return self.inner._names()

    def _valued(self):
        return self.inner._valued()

    def _plain(self, schema):
        return ~self.inner._plain(schema)


@dataclass(frozen=True)
class Both(Expr):
    left: Expr
    right: Expr
    either: bool = False

    def _names(self):
        return [*self.left._names(), *self.right._names()]

    def _valued(self):
        return [*self.left._valued(), *self.right._valued()]

    def _plain(self, schema):
        a, b = self.left._plain(schema), self.right._plain(schema)
        return a | b if self.either else a & b


@dataclass(frozen=True)
class ColumnRef:
    name: str

    def eq(self, value) -> Expr:
        return Compare(self.name, "==", value)

    def neq(self, value) -> Expr:
        return Compare(self.name, "!=", value)

    def lt(self, value) -> Expr:
        return Compare(self.name, "<", value)

    def lte(self, value) -> Expr:
        return Compare(self.name, "<=", value)

    def gt(self, value) -> Expr:
        return Compare(self.name, ">", value)

    def gte(self, value) -> Expr:
        return Compare(self.name, ">=", value)

    def even(self) -> Expr:
        return Even(self.name)

    def is_null(self) -> Expr:
        return Null(self.name, True)

    def is_not_null(self) -> Expr:
        return Null(self.name, False)

    def is_in(self, *values) -> Expr:
        return In(self.name, values)


def col(name: str) -> ColumnRef:
    return ColumnRef(name)


def _predicate(e) -> Expr:
    if not isinstance(e, Expr):
        raise FrameError(f"not a predicate: {e!r}")
    return e


def not_(e: Expr) -> Expr:
    return Not(_predicate(e))


def and_(a: Expr, b: Expr) -> Expr:
    return Both(_predicate(a), _predicate(b))


def or_(a: Expr, b: Expr) -> Expr:
    return Both(_predicate(a), _predicate(b), either=True)
