"""Lazy frames: a source and a list of operators, checked and turned into a Spark plan when collected."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from ..errors import Cancelled, FrameError, UnknownColumn
from ..functions.aggregates import Agg, count
from ..functions.predicates import Even, Expr
from ..operators.frame import Frame
from ..sources.csv import ScanOptions, scan_csv_frame
from ..sources.json import scan_json_frame


class CancelToken:
    """Cancels what runs under it, and whatever is asked for later."""

    def __init__(self):
        self._event, self._calls, self._lock = threading.Event(), {}, threading.Lock()

    @property
    def cancelled(self) -> bool:
        return self._event.is_set()

    def cancel(self) -> None:
        with self._lock:
            self._event.set()
            calls = list(self._calls.values())
        for call in calls:
            call()

    def check(self) -> None:
        if self.cancelled:
            raise Cancelled("cancelled")

    def run(self, spark: SparkSession, work):
        """work(), whose Spark jobs end when the token is cancelled."""
        self.check()
        tag, context = f"cairnframe-{uuid.uuid4().hex}", spark.sparkContext
        with self._lock:
            self._calls[tag] = lambda: context.cancelJobsWithTag(tag)
        context.addJobTag(tag)
        try:
            out = work()
        except Exception as e:
            if self.cancelled:
                raise Cancelled("cancelled") from e
            raise
        finally:
            context.removeJobTag(tag)
            with self._lock:
                del self._calls[tag]
        self.check()
        return out


@dataclass(frozen=True)
class _Op:
    kind: str
    names: tuple[str, ...] = ()
    descending: bool = False
    predicate: Expr | None = None
    aggs: tuple[Agg, ...] = ()

    def __str__(self) -> str:
        # How a plan's lines read.
        if self.kind == "select":
            return f"select({','.join(self.names)})"
        if self.kind == "sort":
            return f"sort({self.names[0]},{'desc' if self.descending else 'asc'})"
        if self.kind == "filter":
            return f"filter(cols=[{','.join(sorted(self.predicate.columns()))}])"
        return f"groupby(keys=[{','.join(sorted(self.names))}] aggs=[{','.join(sorted(a.name or '?' for a in self.aggs))}])"

    def reads(self) -> list[str]:
        return self.predicate.columns() if self.kind == "filter" else list(self.names)

    def apply(self, frame: Frame) -> Frame:
        if self.kind == "select":
            return frame.select(*self.names)
        if self.kind == "sort":
            return frame.sort(self.names[0], self.descending)
        if self.kind == "filter":
            return frame.filter(self.predicate)
        return frame.group_by(*self.names).agg(*self.aggs)


@dataclass(frozen=True)
class _Scan:
    """What the scan itself is asked for: columns (None: all) and a parity filter."""

    columns: frozenset[str] | None = None
    even: str = ""
    rest: tuple[_Op, ...] = ()


@dataclass(frozen=True)
class LazyFrame:
    spark: SparkSession
    source: str
    path: str
    options: ScanOptions = field(default_factory=ScanOptions)
    ops: tuple[_Op, ...] = ()

    def _then(self, op: _Op) -> LazyFrame:
        return replace(self, ops=(*self.ops, op))

    def select(self, *names: str) -> LazyFrame:
        return self._then(_Op("select", names))

    def filter(self, predicate: Expr) -> LazyFrame:
        if not isinstance(predicate, Expr):
            raise FrameError(f"not a predicate: {predicate!r}")
        return self._then(_Op("filter", predicate=predicate))

    def sort(self, column: str, descending: bool = False) -> LazyFrame:
        return self._then(_Op("sort", (column,), descending))

    def group_by(self, *keys: str) -> LazyGroups:
        return LazyGroups(self, keys)

    def _scan(self) -> _Scan:
        """Checks that operators after a select read its columns, and finds what the scan needs."""
        if any(op.kind == "group" for op in self.ops):
            return _Scan(rest=self.ops)
        selects = [i for i, op in enumerate(self.ops) if op.kind == "select"]
        visible, even, rest = None, None, []
        for i, op in enumerate(self.ops):
            unknown = [n for n in op.reads() if visible is not None and n not in visible]
            if unknown:
                raise UnknownColumn(f"{op.kind} unknown column {unknown[0]}")
            if op.kind == "select":
                visible = set(op.names)
            if even is None and isinstance(op.predicate, Even):
                even = i
            else:
                rest.append(op)
        columns = None
        if selects:
            before = [n for op in self.ops[: selects[0] + 1] for n in op.reads()]
            columns = frozenset(before + (self.ops[even].reads() if even is not None else []))
        return _Scan(columns, self.ops[even].predicate.column if even is not None else "", tuple(rest))

    def collect(self, token: CancelToken | None = None) -> Frame:
        """The frame; with a token it is computed here, so that cancelling it ends the work."""
        if token is None:
            return self._frame()

        def work():
            frame = self._frame()
            frame._df.persist()
            frame._df.count()
            return frame

        return token.run(self.spark, work)

    def _frame(self) -> Frame:
        if self.source == "csv":
            # Catalyst moves the parity filter to the scan; here it only has to stay in its place.
            frame = scan_csv_frame(self.spark, self.path, self.options, None if (c := self._scan().columns) is None else sorted(c))
        else:
            frame = scan_json_frame(self.spark, self.path)
        for op in self.ops:
            frame = op.apply(frame)
        return frame

    def explain(self, physical: bool = False) -> str:
        """The plan as text. A plan that can't be made raises its error, whose `explained` has the text so far with the reason."""
        lines = [f"Source: {self.source}", f"Path: {self.path}"]
        ops = self.ops
        if self.source == "csv":
            if self.options.delimiter:
                lines.append(f"Delimiter: {self.options.delimiter}")
            if self.options.null_values:
                lines.append(f"NullValues: {','.join(self.options.null_values)}")
            try:
                scan = self._scan()
            except FrameError as e:
                e.explained = "\n".join([*lines, f"PlanningError: {e}"]) + "\n"
                raise
            columns = "* (all)" if scan.columns is None else f"[{','.join(sorted(scan.columns))}]"
            lines.append(f"Scan: projection={columns}" + (f" filter_even={scan.even}" if scan.even else ""))
            ops = scan.rest
        text = "\n".join([*lines, "Ops:", *(f"- {op}" for op in ops)]) + "\n"
        return text + self._frame().explain() if physical else text


@dataclass(frozen=True)
class LazyGroups:
    frame: LazyFrame
    keys: tuple[str, ...]

    def agg(self, *aggs: Agg) -> LazyFrame:
        return self.frame._then(_Op("group", self.keys, aggs=aggs))

    def count(self) -> LazyFrame:
        return self.agg(count())


def scan_csv(spark: SparkSession, path: str, options: ScanOptions = ScanOptions()) -> LazyFrame:
    return LazyFrame(spark, "csv", path, options)


def scan_json(spark: SparkSession, path: str) -> LazyFrame:
    return LazyFrame(spark, "json", path)
