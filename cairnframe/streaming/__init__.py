"""Predicates and group aggregates over streams: the same lowering, on an unbounded Spark DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.aggregates import Agg
from ..functions.predicates import Expr, quoted
from ..types import Field, Schema, from_spark


def _schema(df: DataFrame) -> Schema:
    return Schema(tuple(Field(f.name, from_spark(f.dataType)) for f in df.schema.fields))


def filter_stream(stream: DataFrame, predicate: Expr) -> DataFrame:
    """Null-strict, as on frames; needs no state."""
    return stream.filter(predicate.keep(_schema(stream)))


def group_stream(stream: DataFrame, key: str, *aggs: Agg) -> DataFrame:
    """One state row for each key; for update or complete output."""
    schema = _schema(stream)
    return stream.groupBy(quoted(key)).agg(*(a.lower(schema) for a in aggs))
