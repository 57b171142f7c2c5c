"""Row order as data: the keys that a frame carries until an operator observes the order.

A key names a column of the Spark frame, visible or hidden. Sorting puts a key in front and moves nothing; slices, previews and
serialisers sort once by all keys. So chained stable sorts compose, although Catalyst drops inner sorts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import quoted

#: Fixed value: a slice that ends within so many rows is a partial sort, whose rows tasks and driver hold.
TOP_ROWS = 4096
#: Spark's monotonic ids: below these bits the place in a partition, above them the partition.
PART_SHIFT = 33


@dataclass(frozen=True)
class Key:
    column: str
    descending: bool = False

    def lower(self, backwards: bool = False) -> Column:
        """Nulls come last either way, or first if backwards."""
        c = quoted(self.column)
        if backwards:
            return c.asc_nulls_first() if self.descending else c.desc_nulls_first()
        return c.desc_nulls_last() if self.descending else c.asc_nulls_last()


def ordered(df: DataFrame, keys: tuple[Key, ...], backwards: bool = False) -> DataFrame:
    return df.orderBy(*(k.lower(backwards) for k in keys)) if keys else df


def hidden(df: DataFrame, hint: str) -> str:
    """A name that no column of df has, whatever its case."""
    have, n = {c.lower() for c in df.columns}, 0
    while f"__{hint}_{n}" in have:
        n += 1
    return f"__{hint}_{n}"


def numbered(df: DataFrame, keys: tuple[Key, ...], name: str, backwards: bool = False) -> DataFrame:
    """df in order, with a position in `name`: increasing, with gaps."""
    return ordered(df, keys, backwards).withColumn(name, F.monotonically_increasing_id())


def counted(df: DataFrame, keys: tuple[Key, ...], at: str, backwards: bool = False) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The numbered frame, which is kept so that all passes see the same partitions; and each partition's number and rows, in order."""
    placed = numbered(df, keys, at, backwards).persist()
    return placed, sorted((r[0], r[1]) for r in placed.groupBy(F.shiftright(at, PART_SHIFT)).count().collect())


def indexed(df: DataFrame, keys: tuple[Key, ...], name: str) -> DataFrame:
    """df with contiguous positions from 0 in `name`.

    Partitions of the sorted frame are counted, and their offsets (one for each partition) added to the place within them; no row
    passes through a single task.
    """
    at, part = hidden(df, "at"), hidden(df, "part")
    placed, parts = counted(df, keys, at)
    offsets, total = [], 0
    for p, n in parts:
        offsets.append((p, total))
        total += n
    offset = placed.sparkSession.createDataFrame(offsets, f"`{part}` long, `{name}` long")
    placed = placed.withColumn(part, F.shiftright(at, PART_SHIFT))
    return placed.join(F.broadcast(offset), part).withColumn(name, F.col(name) + F.col(at).bitwiseAND(F.lit((1 << PART_SHIFT) - 1))).drop(at, part)


def window(df: DataFrame, keys: tuple[Key, ...], offset: int, length: int, backwards: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The rows after the first `offset` in order, `length` at most; and the frame that is kept for them, if any.

    A partial sort holds offset + length rows in each task and in the driver. Where these are many, the sorted frame's partitions are
    counted, and the rows picked by position where they are.
    """
    if offset + length <= TOP_ROWS:
        rows = ordered(df, keys, backwards)
        return (rows.offset(offset) if offset else rows).limit(length), None
    at = hidden(df, "at")
    placed, parts = counted(df, keys, at, backwards)

    def position(rank: int) -> int:
        for p, n in parts:
            if rank < n:
                return (p << PART_SHIFT) + rank
            rank -= n
        return 2**63 - 1

    return placed.filter((F.col(at) >= position(offset)) & (F.col(at) < position(offset + length))).drop(at), placed
