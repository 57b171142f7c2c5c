"""Frames over Parquet: native types stay as they are, and rows are in file order."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.frame import Frame
from ..plans.ordering import Key, hidden


def scan_parquet(spark: SparkSession, path: str, ordered: bool = True) -> Frame:
    """`ordered=False` leaves out the row positions, for plans that don't observe order."""
    df = spark.read.parquet(path)
    names = df.columns
    if not ordered:
        return Frame(df, names)
    # Projected right above the scan, these keep filters pushed down and vanish where nothing observes order.
    file = hidden(df, "file")
    row = hidden(df, "row")
    df = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    return Frame(df, names, (Key(file), Key(row)))
