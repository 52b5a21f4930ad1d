"""Partitioned table output."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_kept(kept: DataFrame, path: str, mode: str = "error") -> None:
    """Kept documents, one partition per serotype; the id is a column.

    Nothing is shuffled: each task adds its rows to the few partitions there are, so a serotype that
    holds most documents is still written by all tasks.
    """
    kept.write.mode(mode).partitionBy("serotype").parquet(path)


def write_region_years(table: DataFrame, path: str, mode: str = "error") -> None:
    """The table behind each year's map, one partition per year."""
    table.write.mode(mode).partitionBy("year").parquet(path)
