"""Aggregates of a group: count, sum, mean, min and max."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FrameError, TypeMismatch, UnknownColumn
from ..types import Kind, Schema
from .predicates import quoted


class AggFunc(Enum):
    COUNT = "count"
    SUM = "sum"
    MEAN = "mean"
    MIN = "min"
    MAX = "max"


@dataclass(frozen=True)
class Agg:
    func: AggFunc
    column: str = ""
    name: str = ""

    def alias(self, name: str) -> Agg:
        return replace(self, name=name)

    @property
    def output(self) -> str:
        if self.name:
            return self.name
        return "count" if self.func is AggFunc.COUNT else f"{self.column}_{self.func.value}"

    def lower(self, schema: Schema) -> Column:
        """Nulls are skipped; a group without values gives null, but a count counts rows."""
        if not isinstance(self.func, AggFunc):
            raise FrameError(f"unknown aggregate {self.func!r}")
        if self.func is AggFunc.COUNT:
            return F.count(F.lit(1)).alias(self.output)
        if not self.column:
            raise FrameError(f"{self.func.value} needs a column")
        field = schema.lookup(self.column)
        if field is None:
            raise UnknownColumn(f"unknown column {self.column!r}")
        if field.dtype.kind not in (Kind.INT, Kind.FLOAT):
            raise TypeMismatch(f"{self.func.value} isn't supported for {field.dtype} column {self.column}")
        c = quoted(self.column)
        return {AggFunc.SUM: F.sum, AggFunc.MEAN: F.avg, AggFunc.MIN: F.min, AggFunc.MAX: F.max}[self.func](c).alias(self.output)


def count() -> Agg:
    return Agg(AggFunc.COUNT)


def sum_(column: str) -> Agg:
    return Agg(AggFunc.SUM, column)


def mean(column: str) -> Agg:
    return Agg(AggFunc.MEAN, column)


def min_(column: str) -> Agg:
    return Agg(AggFunc.MIN, column)


def max_(column: str) -> Agg:
    return Agg(AggFunc.MAX, column)
