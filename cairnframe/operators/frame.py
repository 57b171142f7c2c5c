"""Frames: validated operators over a Spark DataFrame whose row order is part of the data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateColumn, FrameError, LengthMismatch, TypeMismatch, UnknownColumn
from ..functions.aggregates import Agg, count
from ..functions.predicates import Expr, quoted
from ..functions.text import value_text
from ..plans.ordering import TOP_ROWS, Key, hidden, indexed, numbered, ordered, window
from ..types import DataType, Field, Kind, Schema, from_spark


def check_names(names: list[str], case_sensitive: bool) -> None:
    if not names:
        raise FrameError("a frame needs a column")
    if any(not n for n in names):
        raise FrameError("a column needs a name")
    seen = set()
    for n in names:
        key = n if case_sensitive else n.lower()
        if key in seen:
            raise DuplicateColumn(f"duplicate column {n!r}" + ("" if case_sensitive else " (names that differ in case only need spark.sql.caseSensitive)"))
        seen.add(key)


class Frame:
    """Immutable. `keys` order the rows; a frame without keys is in no order, and operators that observe order refuse it."""

    def __init__(self, df: DataFrame, names: list[str], keys: tuple[Key, ...] = ()):
        check_names(names, df.sparkSession.conf.get("spark.sql.caseSensitive", "false").lower() == "true")
        self._df, self._names, self._keys = df, list(names), tuple(keys)
        types = {f.name: f.dataType for f in df.schema.fields}
        self.schema = Schema(tuple(Field(n, from_spark(types[n])) for n in names))

    # --- metadata -------------------------------------------------------------------------------------------------
    @property
    def columns(self) -> list[str]:
        return list(self._names)

    @property
    def width(self) -> int:
        return len(self._names)

    @property
    def height(self) -> int:
        return self._df.count()

    @property
    def shape(self) -> tuple[int, int]:
        return self.height, self.width

    def column(self, name: str) -> Series:
        self._known(name)
        return Series(self, name)

    def series(self) -> list[Series]:
        return [Series(self, n) for n in self._names]

    def to_spark(self, ordered_rows: bool = False) -> DataFrame:
        df = ordered(self._df, self._keys) if ordered_rows else self._df
        return df.select(*map(quoted, self._names))

    def collect(self) -> list[tuple]:
        """All rows, in order, on the driver."""
        return [tuple(r) for r in self.to_spark(ordered_rows=True).collect()]

    def explain(self) -> str:
        return self._df.sparkSession._jvm.PythonSQLUtils.explainString(self.to_spark(True)._jdf.queryExecution(), "formatted")

    def _known(self, *names: str) -> None:
        for n in names:
            if n not in self._names:
                raise UnknownColumn(f"unknown column {n!r}")

    def _hide(self, names) -> tuple[DataFrame, tuple[Key, ...]]:
        """Order keys among `names`, which are about to go or change, live on as hidden columns."""
        df, keys = self._df, list(self._keys)
        for n in names:
            if any(k.column == n for k in keys):
                new = hidden(df, "key")
                df = df.withColumnRenamed(n, new)
                keys = [Key(new, k.descending) if k.column == n else k for k in keys]
            else:
                df = df.drop(quoted(n))
        return df, tuple(keys)

    def _order_needed(self) -> None:
        if not self._keys:
            raise FrameError("this frame is in no order")

    # --- projection and shape -------------------------------------------------------------------------------------
    def select(self, *names: str) -> Frame:
        self._known(*names)
        check_names(list(names), True)
        df, keys = self._hide([n for n in self._names if n not in names])
        return Frame(df, list(names), keys)

    def drop(self, *names: str) -> Frame:
        if not names:
            return self
        self._known(*names)
        left = [n for n in self._names if n not in names]
        if not left:
            raise FrameError("a frame needs a column")
        return self.select(*left)

    def rename(self, old: str, new: str) -> Frame:
        if not old or not new:
            raise FrameError("a column needs a name")
        self._known(old)
        if old == new:
            return self
        if new in self._names:
            raise DuplicateColumn(f"duplicate column {new!r}")
        df = self._df.withColumnRenamed(old, new)
        return Frame(df, [new if n == old else n for n in self._names], tuple(Key(new, k.descending) if k.column == old else k for k in self._keys))

    def with_columns(self, *columns) -> Frame:
        """Attaches local columns, or other frames' series, by position: in place if the name is known, else at the end."""
        if not columns:
            return self
        self._order_needed()
        names = [c.name for c in columns]
        check_names(names, True)
        spark, height, at = self._df.sparkSession, self.height, hidden(self._df, "row")
        base = indexed(self._df, self._keys, at)
        own, keys = Frame(base, [*self._names, at], self._keys)._hide([n for n in self._names if n in names])
        for c in columns:
            if len(c) != height:
                raise LengthMismatch(f"column {c.name!r} has {len(c)} rows, the frame {height}")
            if isinstance(c, Series):
                # Under another name of its own first: the other frame may have columns of any name.
                other, place, value = c.frame._df, hidden(c.frame._df, "row"), hidden(c.frame._df, "value")
                c.frame._order_needed()
                side = indexed(other, c.frame._keys, place).select(quoted(place).alias(at), quoted(c.name).alias(value))
            else:
                value = hidden(own, "value")
                side = spark.createDataFrame([(i, v) for i, v in enumerate(c.values)], f"`{at}` long, `{value}` {c.dtype.to_spark().simpleString()}")
            own = own.join(side, at).withColumnRenamed(value, c.name)
        order = [*self._names, *(n for n in names if n not in self._names)]
        return Frame(own.drop(at), order, keys)

    # --- rows -----------------------------------------------------------------------------------------------------
    def filter(self, predicate: Expr) -> Frame:
        if not isinstance(predicate, Expr):
            raise FrameError(f"not a predicate: {predicate!r}")
        return Frame(self._df.filter(predicate.keep(self.schema)), self._names, self._keys)

    def slice(self, offset: int, length: int) -> Frame:
        if offset < 0 or length < 0:
            raise FrameError("offset and length can't be negative")
        self._order_needed()
        return Frame(window(self._df, self._keys, offset, length)[0], self._names, self._keys)

    def head(self, n: int) -> Frame:
        return self.slice(0, n)

    limit = head

    def tail(self, n: int) -> Frame:
        if n < 0:
            raise FrameError("a length can't be negative")
        self._order_needed()
        return Frame(window(self._df, self._keys, 0, n, backwards=True)[0], self._names, self._keys)

    def sort(self, column: str, descending: bool = False) -> Frame:
        """Stable: rows that agree stay in the order they had. Nulls come last either way."""
        self._known(column)
        if self.schema.lookup(column).dtype.kind not in (Kind.INT, Kind.FLOAT, Kind.BOOL, Kind.UTF8):
            raise TypeMismatch(f"column {column!r} can't be sorted")
        return Frame(self._df, self._names, (Key(column, descending), *(k for k in self._keys if k.column != column)))

    # --- groups ---------------------------------------------------------------------------------------------------
    def group_by(self, *keys: str) -> Grouped:
        if not keys:
            raise FrameError("a group needs a key")
        self._known(*keys)
        return Grouped(self, keys)

    def __repr__(self) -> str:
        return f"Frame({', '.join(f'{f.name}: {f.dtype}' for f in self.schema.fields)})"

    def __str__(self) -> str:
        from .render import table

        return table(self)


class Grouped:
    """Groups by one int64 or utf8 column; a null key is a group of its own."""

    def __init__(self, frame: Frame, keys: tuple[str, ...]):
        self.frame, self.keys = frame, keys

    def agg(self, *aggs: Agg) -> Frame:
        """The key, then the aggregates in the order given; groups in the order in which they are first seen."""
        frame = self.frame
        if len(self.keys) != 1:
            raise FrameError("groups have exactly one key")
        if not aggs:
            raise FrameError("an aggregate is needed")
        key, names = self.keys[0], [a.output for a in aggs]
        lowered = [a.lower(frame.schema) for a in aggs]
        check_names(names, True)
        if key in names:
            raise DuplicateColumn(f"duplicate column {key!r}")
        if frame.schema.lookup(key).dtype.kind not in (Kind.INT, Kind.UTF8):
            raise TypeMismatch(f"column {key!r} can't be a key")
        df, keys = frame._df, frame._keys
        if not keys:
            return Frame(df.groupBy(quoted(key)).agg(*lowered), [key, *names])
        first = hidden(df, "first")
        if any(k.column in frame._names or k.descending for k in keys):
            at = hidden(df, "at")
            df, place = numbered(df, keys, at), quoted(at)
        else:
            place = F.struct(*(quoted(k.column) for k in keys))
        return Frame(df.groupBy(quoted(key)).agg(*lowered, F.min(place).alias(first)), [key, *names], (Key(first),))

    def count(self) -> Frame:
        return self.agg(count())


@dataclass(frozen=True)
class Series:
    """A frame's column; its values come to the driver when they are asked for."""

    frame: Frame
    name: str

    @property
    def dtype(self) -> DataType:
        return self.frame.schema.lookup(self.name).dtype

    def __len__(self) -> int:
        return self.frame.height

    def values(self) -> list:
        """A copy, in order; nulls are None."""
        return [r[0] for r in ordered(self.frame._df, self.frame._keys).select(quoted(self.name)).collect()]

    def value(self, i: int):
        """The i-th value, from the end if negative. No more than TOP_ROWS rows of this column come to the driver."""
        n, backwards = (i, False) if i >= 0 else (-i - 1, True)
        frame = self.frame.select(self.name)
        frame._order_needed()
        if n >= TOP_ROWS and 0 <= (left := len(self) - 1 - n) < n:
            n, backwards = left, not backwards
        rows, kept = window(frame._df, frame._keys, n, 1, backwards)
        try:
            found = rows.select(quoted(self.name)).collect()
        finally:
            if kept is not None:
                kept.unpersist()
        if not found:
            raise IndexError(f"row {i} of column {self.name!r}")
        return found[0][0]

    def is_null(self, i: int) -> bool:
        return self.value(i) is None

    def value_string(self, i: int) -> str:
        return value_text(self.value(i))

    def _typed(self, kind: Kind) -> Series | None:
        return self if self.dtype.kind is kind else None

    def int64(self) -> Series | None:
        return self._typed(Kind.INT)

    def float64(self) -> Series | None:
        return self._typed(Kind.FLOAT)

    def bool(self) -> Series | None:
        return self._typed(Kind.BOOL)

    def utf8(self) -> Series | None:
        return self._typed(Kind.UTF8)
