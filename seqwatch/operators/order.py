"""Rows of files in the order they stand in: their numbers, the first of them, and values as they first appear.

A file that is read by many tasks has an order all the same: blocks follow each other, and a task reads a block from its beginning to its end. Counting
the rows of each block gives every block the number of its first row; nothing but these counts is moved.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from seqwatch.functions.cases import blank_to_null

FILE, BLOCK = "source_file", "block_start"

#: Blocks of which a table of one row each is broadcast; the numbers of more are joined by a shuffle of the rows.
MOST_BROADCAST = 500_000


def with_row_numbers(files: DataFrame, name: str = "row") -> DataFrame:
    """Rows as read from files, with their number from 0: files in the order of their paths, rows in the order they stand in.

    ``files`` is what a reader of files gives, with nothing but filters and projections of rows above it that keep their order; filtered rows have no number. The
    numbers are the same however the files are cut for reading. The files are read twice, the first time only to be counted.
    """
    places = files.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK))
    return numbered(places, name).drop(FILE, BLOCK)


def numbered(rows: DataFrame, name: str = "row") -> DataFrame:
    """``with_row_numbers`` for rows that have their file and block in columns."""
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    blocks = block_offsets(placed)
    # The rows come from the same scan as their counts, so the same task numbers them.
    if rows.rdd.getNumPartitions() <= MOST_BROADCAST:
        blocks = F.broadcast(blocks)
    joined = placed.join(blocks, [FILE, BLOCK])
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_offset") + F.col("_at") - F.col("_first")).alias(name))


def block_offsets(placed: DataFrame, at: str = "_at") -> DataFrame:
    """source_file, block_start, _first, _offset: where each block's rows begin, in the task's own numbers and in all files'."""
    blocks = placed.groupBy(FILE, BLOCK).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"))
    before = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    within = blocks.withColumn("_within", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # One row per file, of which the driver has made a list to plan the read.
    sizes = blocks.groupBy(FILE).agg(F.sum("_n").alias("_n_file"))
    earlier = Window.orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(FILE, F.coalesce(F.sum("_n_file").over(earlier), F.lit(0)).alias("_before"))
    return within.join(sizes, FILE).select(FILE, BLOCK, "_first", (F.col("_before") + F.col("_within")).alias("_offset"))


def first_rows(read: Callable[[Sequence[str]], DataFrame], files: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of files, in order, with their ``row`` numbers. ``read`` reads some of them.

    As many files are looked at as hold the rows, in the order of their names.
    """
    files = sorted(files)
    taken = 1
    while True:
        rows = with_row_numbers(read(files[:taken])).where(F.col("row") < n)
        # No more rows than are asked for.
        if taken >= len(files) or rows.count() >= n:
            return rows.orderBy("row")
        taken *= 2


def distinct_in_order(files: DataFrame, column: str, blanks_are_null: bool = False) -> DataFrame:
    """The different values of a column with the row they first stand in, in that order. A missing value is one, too."""
    value = F.col(f"`{column}`")
    rows = with_row_numbers(files, "row").select((blank_to_null(value) if blanks_are_null else value).alias(column), "row")
    return rows.groupBy(column).agg(F.min("row").alias("first_row")).orderBy("first_row")
