"""A frame as a text table: shape, column statistics, and the first and last rows."""

from __future__ import annotations

import os
import shutil
from dataclasses import dataclass

from pyspark.sql import functions as F

from ..functions.predicates import quoted
from ..functions.text import value_text
from ..types import Kind
from .frame import Frame

GAP = "..."


@dataclass(frozen=True)
class TableOptions:
    head: int = 5
    tail: int = 5
    max_cols: int = 12
    max_col_width: int = 20
    max_table_width: int = 0
    stats_rows: int = 10_000


def _cut(s: str, width: int) -> str:
    return s if len(s) <= width else s[:width] if width <= 3 else s[: width - 3] + GAP


def _width() -> int:
    wide = os.get_terminal_size().columns - 1 if os.isatty(1) else 0
    return wide if wide >= 39 else max(shutil.get_terminal_size((120, 24)).columns, 40)


def _shown(names: list[str], budget: int, most: int) -> list[str | None]:
    """The columns that fit at six characters each: those at either end, and None for what is left out between."""
    fits = max(1, (budget - 8) // 9)
    n = min(len(names), fits, most if most > 0 else len(names))
    if n == len(names) or n <= 2:
        return names[:n]
    left = (n - 1) // 2
    return [*names[:left], None, *names[len(names) - (n - 1 - left) :]]


def _statistics(frame: Frame, names: list[str], rows: int) -> list[str]:
    """One aggregate over the first rows."""
    wanted = []
    for i, n in enumerate(names):
        c, kind = quoted(n), frame.schema.lookup(n).dtype.kind
        wanted.append(F.count_if(c.isNull()).alias(f"nulls{i}"))
        if kind in (Kind.INT, Kind.FLOAT):
            wanted += [F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"), F.avg(c).alias(f"m{i}")]
        elif kind is Kind.BOOL:
            wanted.append(F.count_if(c).alias(f"a{i}"))
        elif kind is Kind.UTF8:
            wanted += [F.min(F.octet_length(c)).alias(f"a{i}"), F.max(F.octet_length(c)).alias(f"b{i}")]
    first = frame.head(rows)._df if frame._keys else frame._df.limit(rows)
    got, out = first.agg(*wanted).first(), []
    for i, n in enumerate(names):
        dtype = frame.schema.lookup(n).dtype
        nulls = got[f"nulls{i}"]
        text = f"nulls={nulls}/{rows}"
        if dtype.kind is Kind.BOOL:
            text += f" true={got[f'a{i}']}/{rows - nulls}"
        elif nulls < rows and dtype.kind is Kind.UTF8:
            text += f" len=[{got[f'a{i}']},{got[f'b{i}']}]"
        elif nulls < rows and dtype.kind is Kind.INT:
            text += f" min={got[f'a{i}']} max={got[f'b{i}']} mean={got[f'm{i}']:.4g}"
        elif nulls < rows and dtype.kind is Kind.FLOAT:
            text += f" min={got[f'a{i}'] + 0.0:.4g} max={got[f'b{i}'] + 0.0:.4g} mean={got[f'm{i}']:.4g}"
        out.append(f"- {n}: {dtype}  {text}")
    return out


def table(frame: Frame, options: TableOptions = TableOptions()) -> str:
    height, head, tail = frame.height, max(0, options.head), max(0, options.tail)
    budget = options.max_table_width if options.max_table_width > 0 else _width()
    shown = _shown(frame.columns, budget, options.max_cols)
    names = [n for n in shown if n is not None]
    lines = [f"DataFrame shape: ({height}, {frame.width})"]
    if len(names) != frame.width:
        lines.append(f"Preview columns: {len(names)} of {frame.width}")
    measured = min(height, options.stats_rows)
    if measured > 0:
        lines.append("Columns:" if measured == height else f"Columns (stats: first {measured} rows):")
        lines += [_cut(s, budget) for s in _statistics(frame, names, measured)] + [""]

    preview = frame.select(*names)
    rows: list[tuple[str, list[str]]] = []

    def take(part: Frame, at: int) -> None:
        for i, row in enumerate(part.collect()):
            cells = iter("null" if v is None else '""' if v == "" else value_text(v) for v in row)
            rows.append((str(at + i), [GAP if n is None else next(cells) for n in shown]))

    if head + tail >= height > 0 and head + tail > 0:
        take(preview, 0)
    elif height > 0 and head + tail > 0:
        if head:
            take(preview.head(head), 0)
        rows.append((GAP, [GAP] * len(shown)))
        if tail:
            take(preview.tail(tail), height - tail)
    most = options.max_col_width if options.max_col_width > 0 else 20
    most = max(4, min(most, (budget - 8 - 3 * len(shown)) // len(shown)))
    header = ["idx", *(GAP if n is None else n for n in shown)]
    grid = [header, *([i, *cells] for i, cells in rows)]
    grid = [[row[0], *(_cut(c, most) for c in row[1:])] for row in grid]
    widths = [max(len(row[k]) for row in grid) for k in range(len(header))]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    drawn = ["| " + " | ".join(c.ljust(w) for c, w in zip(row, widths)) + " |" for row in grid]
    return "\n".join([*lines, rule, drawn[0], rule, *drawn[1:], rule]) + "\n"
