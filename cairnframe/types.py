"""Type descriptors and their Spark types."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

from .errors import TypeMismatch


class Kind(Enum):
    INVALID = "invalid"
    INT = "int"
    UINT = "uint"
    FLOAT = "float"
    BOOL = "bool"
    UTF8 = "utf8"
    BINARY = "binary"
    DATE = "date"
    DATETIME = "datetime"
    DURATION = "duration"


class TimeUnit(Enum):
    NONE = ""
    NS = "ns"
    US = "us"
    MS = "ms"


@dataclass(frozen=True)
class DataType:
    kind: Kind
    bits: int = 0
    unit: TimeUnit = TimeUnit.NONE
    zone: str = ""

    def __str__(self) -> str:
        if self.kind in (Kind.INT, Kind.UINT, Kind.FLOAT):
            return f"{self.kind.value}{self.bits}"
        inner = ",".join(x for x in (self.unit.value, self.zone) if x)
        return f"{self.kind.value}[{inner}]" if inner and self.kind in (Kind.DATETIME, Kind.DURATION) else self.kind.value

    def to_spark(self) -> T.DataType:
        plain = {
            Kind.INT: T.LongType(),
            Kind.FLOAT: T.DoubleType(),
            Kind.BOOL: T.BooleanType(),
            Kind.UTF8: T.StringType(),
            Kind.UINT: T.DecimalType(20, 0) if self.bits == 64 else T.LongType(),
            Kind.BINARY: T.BinaryType(),
            Kind.DATE: T.DateType(),
            Kind.DATETIME: T.TimestampType() if self.zone else T.TimestampNTZType(),
            Kind.DURATION: T.DayTimeIntervalType(),
        }
        if self.kind not in plain:
            raise TypeMismatch(f"{self} has no Spark type")
        return plain[self.kind]


def Int(bits: int = 64) -> DataType:
    return DataType(Kind.INT, bits)


def UInt(bits: int = 64) -> DataType:
    return DataType(Kind.UINT, bits)


def Float(bits: int = 64) -> DataType:
    return DataType(Kind.FLOAT, bits)


def Bool() -> DataType:
    return DataType(Kind.BOOL)


def Utf8() -> DataType:
    return DataType(Kind.UTF8)


def Binary() -> DataType:
    return DataType(Kind.BINARY)


def Date() -> DataType:
    return DataType(Kind.DATE)


def Datetime(unit: TimeUnit = TimeUnit.NONE, zone: str = "") -> DataType:
    return DataType(Kind.DATETIME, 0, unit, zone)


def Duration(unit: TimeUnit = TimeUnit.NONE) -> DataType:
    return DataType(Kind.DURATION, 0, unit)


INT64, FLOAT64, BOOL, UTF8 = Int(64), Float(64), Bool(), Utf8()


def from_spark(t: T.DataType) -> DataType:
    """Every integral Spark type counts as int64 and every floating one as float64; what has no counterpart is invalid."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT64
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return FLOAT64
    if isinstance(t, T.TimestampType):
        return Datetime(TimeUnit.US, "UTC")
    known = {T.BooleanType: BOOL, T.StringType: UTF8, T.BinaryType: Binary(), T.DateType: Date(), T.TimestampNTZType: Datetime(TimeUnit.US), T.DayTimeIntervalType: Duration(TimeUnit.US)}
    return known.get(type(t), DataType(Kind.INVALID))


@dataclass(frozen=True)
class Field:
    name: str
    dtype: DataType


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]

    def lookup(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]
