"""Helpers the operators share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqwatch import session
from seqwatch.session import scratch_path

#: Rows of long texts that a task works on at once.
ROWS = 512


def store(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again.

    This cuts the lineage, so row numbers and random draws made above it cannot change when a lost
    executor's tasks run again, and later stages start from files that every executor can reach.
    """
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def unit(*parts: Column | int) -> Column:
    """A number in (0, 1) that depends on nothing but the arguments."""
    mixed = F.xxhash64(*[F.lit(part) if isinstance(part, int) else part for part in parts])
    return (F.shiftrightunsigned(mixed, 12).cast("double") + 0.5) * (2.0**-52)


def carried(column: Column) -> Column:
    """An id on its way through pandas, which would make a column of long numbers with nulls one of doubles."""
    return column.cast("string")


def free_name(frame: DataFrame, name: str) -> str:
    """The name, or one like it that the frame doesn't have."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, inside an expression."""
    return F.transform(F.array(value), body)[0]


def ship_package(spark: SparkSession) -> None:
    session.ship_package(spark)


def in_slices(work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], rows: int = ROWS):
    """``work`` on frames of few rows instead of whole batches, with the memory it has freed handed back after each batch.

    A batch is cut by its number of rows, so its texts can be many times what a worker should hold copies and
    parts of. Workers live on after their tasks, and what one task has left in their heaps would be there beside the next one's.
    """

    @functools.wraps(work)
    def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts() -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start in range(0, len(batch), rows):
                    yield batch.iloc[start : start + rows].reset_index(drop=True)
                del batch
                hand_back()

        yield from work(parts())
        hand_back()

    return sliced


def hand_back() -> None:
    """Give the system what this process has freed. Only the C library of Linux has a way to; elsewhere nothing happens."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim:
        trim(0)


@functools.cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None
