"""Frames from values in memory: typed columns, a builder, mappings and records."""

from __future__ import annotations

import dataclasses
import numbers
import types
import typing

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..errors import FrameError, LengthMismatch, TypeMismatch
from ..plans.ordering import Key
from ..types import BOOL, FLOAT64, INT64, UTF8, DataType, Kind
from .frame import Frame, check_names

#: What a missing record leaves in a field that can't be null.
ZERO = {Kind.INT: 0, Kind.FLOAT: 0.0, Kind.BOOL: False, Kind.UTF8: ""}


def _fit(v, kind: Kind, name: str):
    if v is None:
        return None
    if kind is Kind.INT and isinstance(v, numbers.Integral) and not isinstance(v, bool):
        if not -(2**63) <= v < 2**63:
            raise TypeMismatch(f"{v} in column {name!r} is beyond int64")
        return int(v)
    if kind is Kind.FLOAT and isinstance(v, numbers.Real) and not isinstance(v, bool):
        return float(v)
    if kind is Kind.BOOL and isinstance(v, bool) or kind is Kind.UTF8 and isinstance(v, str):
        return v
    raise TypeMismatch(f"{v!r} doesn't fit column {name!r}")


class LocalColumn:
    """A named, typed column; `valid` says which values aren't null (all, if None)."""

    def __init__(self, name: str, dtype: DataType, values, valid=None):
        values = list(values)
        if valid is not None:
            valid = list(valid)
            if len(valid) != len(values):
                raise LengthMismatch(f"column {name!r} has {len(values)} values and {len(valid)} validity flags")
            values = [v if ok else None for v, ok in zip(values, valid)]
        self.name, self.dtype = name, dtype
        self._values = tuple(_fit(v, dtype.kind, name) for v in values)

    @property
    def values(self) -> list:
        return list(self._values)

    def __len__(self) -> int:
        return len(self._values)


def int64_column(name, values, valid=None) -> LocalColumn:
    return LocalColumn(name, INT64, values, valid)


def float64_column(name, values, valid=None) -> LocalColumn:
    return LocalColumn(name, FLOAT64, values, valid)


def bool_column(name, values, valid=None) -> LocalColumn:
    return LocalColumn(name, BOOL, values, valid)


def utf8_column(name, values, valid=None) -> LocalColumn:
    return LocalColumn(name, UTF8, values, valid)


def column_of(name: str, values) -> LocalColumn:
    """Typed by its values: bool, int64, float64 (also integers among floats) or utf8. None is null; without values it is int64."""
    values = list(values)
    kinds = {bool if isinstance(v, bool) else int if isinstance(v, numbers.Integral) else float if isinstance(v, numbers.Real) else type(v) for v in values if v is not None}
    dtype = {frozenset(): INT64, frozenset({bool}): BOOL, frozenset({int}): INT64, frozenset({float}): FLOAT64, frozenset({int, float}): FLOAT64, frozenset({str}): UTF8}.get(frozenset(kinds))
    if dtype is None:
        raise TypeMismatch(f"column {name!r} has values of types {sorted(k.__name__ for k in kinds)}")
    return LocalColumn(name, dtype, values)


def frame_of(spark: SparkSession, *columns: LocalColumn) -> Frame:
    if any(c is None for c in columns):
        raise FrameError("a column is missing")
    check_names([c.name for c in columns], True)
    sizes = {len(c) for c in columns}
    if len(sizes) > 1:
        raise LengthMismatch("columns of different lengths: " + ", ".join(f"{c.name} {len(c)}" for c in columns))
    place = "__row_0"
    while place in {c.name.lower() for c in columns}:
        place += "_"
    schema = T.StructType([T.StructField(c.name, c.dtype.to_spark()) for c in columns] + [T.StructField(place, T.LongType())])
    rows = list(zip(*(c.values for c in columns), range(sizes.pop())))
    return Frame(spark.createDataFrame(rows, schema), [c.name for c in columns], (Key(place),))


class FrameBuilder:
    """Columns one by one. Errors are gathered, and build() raises them together."""

    def __init__(self, spark: SparkSession):
        self._spark, self._columns, self._errors = spark, {}, []

    def add(self, name: str, values) -> FrameBuilder:
        name = name.strip()
        if not name:
            self._errors.append("a column needs a name")
            return self
        try:
            self._columns[name] = column_of(name, values)
        except FrameError as e:
            self._errors.append(str(e))
        return self

    def build(self) -> Frame:
        errors = list(self._errors)
        if not errors:
            try:
                return frame_of(self._spark, *self._columns.values())
            except FrameError as e:
                errors.append(str(e))
        # Fixed value: the heading of several errors, and a dash before each, are part of what a builder promises.
        raise FrameError(errors[0] if len(errors) == 1 else "multiple errors:\n" + "\n".join(f"- {e}" for e in errors))


def from_map(spark: SparkSession, columns: dict) -> Frame:
    """Columns in the order of their names."""
    if not columns:
        raise FrameError("the mapping is empty")
    builder = FrameBuilder(spark)
    for name in sorted(columns):
        builder.add(name, columns[name])
    return builder.build()


@dataclasses.dataclass(frozen=True)
class _RecordField:
    attribute: str
    name: str
    dtype: DataType
    nullable: bool


def _record_fields(cls, tag: str, use_json: bool) -> list[_RecordField]:
    hints, out = typing.get_type_hints(cls), []
    for f in dataclasses.fields(cls):
        hint, nullable = hints[f.name], False
        if typing.get_origin(hint) in (typing.Union, types.UnionType):
            inner = [a for a in typing.get_args(hint) if a is not type(None)]
            nullable, hint = len(inner) < len(typing.get_args(hint)), inner[0] if len(inner) == 1 else None
        dtype = {int: INT64, float: FLOAT64, bool: BOOL, str: UTF8}.get(hint)
        if f.name.startswith("_") or dtype is None:
            continue
        name = str(f.metadata.get(tag, "")).strip()
        if not name and use_json:
            name = str(f.metadata.get("json", "")).split(",")[0].strip()
        if name == "-":
            continue
        out.append(_RecordField(f.name, name or f.name, dtype, nullable))
    return out


def from_records(spark: SparkSession, records, cls=None, tag: str = "name", use_json: bool = False) -> Frame:
    """A frame of dataclass instances, with a column for each public field of a supported type.

    A field's metadata under `tag` names its column ("-" leaves it out), else, with use_json, that under "json". Only optional
    fields are nullable: a missing record (None) leaves null in those and the zero value in others.
    """
    records = list(records)
    cls = cls or next((type(r) for r in records if r is not None), None)
    if cls is None or not dataclasses.is_dataclass(cls):
        raise TypeMismatch("records must be instances of a dataclass")
    fields = _record_fields(cls, tag, use_json)
    if not fields:
        raise FrameError(f"{cls.__name__} has no usable fields")
    columns = []
    for f in fields:
        missing = None if f.nullable else ZERO[f.dtype.kind]
        values = [missing if r is None else getattr(r, f.attribute) for r in records]
        if not f.nullable and any(v is None for v in values):
            raise TypeMismatch(f"field {f.attribute} can't be null")
        columns.append(LocalColumn(f.name, f.dtype, values))
    return frame_of(spark, *columns)
