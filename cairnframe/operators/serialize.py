"""Rows as JSON text, and the checksum of a projection."""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import functions as F

from ..errors import FrameError
from ..functions.predicates import quoted
from ..functions.text import float_text, value_text
from ..plans.ordering import ordered
from ..types import Kind
from .frame import Frame

#: How control characters are written in JSON.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
SPECIAL = re.compile(r'[\\"\x00-\x1f]')
#: What stands between cells and after rows in the checksum's input.
CELL_END, ROW_END = "\x1f", "\n"


def _string(s: str) -> str:
    return '"' + SPECIAL.sub(lambda m: ESCAPES.get(m[0]) or f"\\u{ord(m[0]):04x}", s) + '"'


def _json(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, str):
        return _string(v)
    if isinstance(v, float):
        if not math.isfinite(v):
            raise FrameError(f"{v} has no JSON form")
        return float_text(v)
    return value_text(v)


def _stream(frame: Frame, names: list[str]):
    """Rows in order, a partition at a time."""
    kinds = [frame.schema.lookup(n).dtype.kind for n in names]
    for n, k in zip(names, kinds):
        if k not in (Kind.INT, Kind.FLOAT, Kind.BOOL, Kind.UTF8):
            raise FrameError(f"column {n!r} has no text form")
    return ordered(frame._df, frame._keys).select(*map(quoted, names)).toLocalIterator(prefetchPartitions=True)


def rows_json(frame: Frame) -> str:
    """[{"name":value,...},...] in column and row order."""
    keys = [_string(n) + ":" for n in frame.columns]
    return "[" + ",".join("{" + ",".join(k + _json(v) for k, v in zip(keys, row)) + "}" for row in _stream(frame, frame.columns)) + "]"


def projection_checksum(frame: Frame, most_columns: int = 1) -> str:
    """SHA-256 of the first columns' cells in row order; null and empty text read alike. Depends on the order, so it is streamed."""
    names = frame.columns[: max(1, most_columns)]
    out = hashlib.sha256()
    kinds = {frame.schema.lookup(n).dtype.kind for n in names}
    if Kind.FLOAT in kinds or not kinds <= {Kind.INT, Kind.BOOL, Kind.UTF8}:
        for row in _stream(frame, names):
            out.update((CELL_END.join(map(value_text, row)) + ROW_END).encode())
        return out.hexdigest()
    # Cells of these types read alike in Spark, so whole rows are written there.
    line = F.concat(F.concat_ws(CELL_END, *(F.coalesce(quoted(n).cast("string"), F.lit("")) for n in names)), F.lit(ROW_END))
    for (text,) in ordered(frame._df, frame._keys).select(line.alias("line")).toLocalIterator(prefetchPartitions=True):
        out.update(text.encode())
    return out.hexdigest()
