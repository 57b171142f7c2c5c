"""CSV: one file with a header, null tokens, types inferred from the first rows, strict parsing of the rest."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FrameError, ParseError
from ..functions.predicates import quoted
from ..operators.frame import Frame, check_names
from ..plans.ordering import Key, hidden

# The tokens that read as null unless others are given, the sample's rows, and how values are recognised.
NULL_TOKENS = ("", "NULL", "null")
SAMPLE_ROWS = 8192
INTEGER = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
TRUE, FALSE = ("1", "t", "true"), ("0", "f", "false")


@dataclass(frozen=True)
class ScanOptions:
    """`multiline` reads quoted line ends, a file to a task; without it files split. `strict` checks every row's cell count."""

    delimiter: str = ""
    null_values: tuple[str, ...] = ()
    multiline: bool = True
    strict: bool = True


def infer(values: list[str]) -> T.DataType:
    """int64, float64, bool or utf8, the first that all values fit; int64 where there are none."""
    if all(re.match(INTEGER, v) and -(2**63) <= int(v) < 2**63 for v in values):
        return T.LongType()
    if all(re.match(FLOAT, v) for v in values):
        return T.DoubleType()
    if all(v.lower() in TRUE + FALSE for v in values):
        return T.BooleanType()
    return T.StringType()


def parse(text: Column, kind: T.DataType, name: str) -> Column:
    """The typed value; a text that doesn't fit stops the query."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BooleanType):
        low = F.lower(text)
        value = F.when(low.isin(*TRUE), F.lit(True)).when(low.isin(*FALSE), F.lit(False))
    else:
        value = F.when(text.rlike(INTEGER if isinstance(kind, T.LongType) else FLOAT), text.try_cast(kind.simpleString()))
    wrong = F.raise_error(F.concat(F.lit(f"column {name}: can't parse value "), text)).cast(kind)
    return F.when(text.isNull(), F.lit(None).cast(kind)).otherwise(F.coalesce(value, wrong))


def scan_csv_frame(spark: SparkSession, path: str, options: ScanOptions = ScanOptions(), columns: list[str] | None = None) -> Frame:
    """The file as a frame, of the named columns (in header order) if given."""

    def reader(pruned: bool):
        # An empty cell may come as null, as text() makes it empty again. By default a NUL before a quote is an escape and goes; here a noncharacter is.
        return spark.read.options(sep=options.delimiter or ",", multiLine=options.multiline, quote='"', escape='"', charToEscapeQuoteEscaping="\uffff", nullValue="", emptyValue="", mode="FAILFAST", columnPruning=pruned, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)

    try:
        first = reader(True).csv(path, header=False).head(1)
    except Exception as e:
        raise FrameError(f"can't read {path}: {e}") from e
    if not first:
        raise FrameError(f"{path} is empty")
    names = ["" if v is None else v for v in first[0]]
    check_names(names, spark.conf.get("spark.sql.caseSensitive", "false").lower() == "true")
    chosen = names if columns is None else [n for n in names if n in columns]
    if not chosen:
        raise FrameError(f"{path} has none of the columns {sorted(columns or [])}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = reader(not options.strict).schema(schema).csv(path, header=True)
    tokens = list(options.null_values or NULL_TOKENS)
    block, row = hidden(raw, "block"), hidden(raw, "row")

    def text(n: str) -> Column:
        value = F.coalesce(quoted(n), F.lit(""))
        return F.when(~value.isin(tokens), value)

    try:
        sample = raw.select(*(text(n).alias(n) for n in chosen)).take(SAMPLE_ROWS)
    except Exception as e:
        raise ParseError(f"can't read {path}: {e}") from e
    kinds = [infer([r[i] for r in sample if r[i] is not None]) for i in range(len(chosen))]
    df = raw.select(*(parse(text(n), k, n).alias(n) for n, k in zip(chosen, kinds)), F.col("_metadata.file_block_start").alias(block), F.monotonically_increasing_id().alias(row))
    return Frame(df, chosen, (Key(block), Key(row)))
