"""Derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def computed_once(frame: DataFrame, *columns: str) -> DataFrame:
    """Let derived columns behave like stored ones.

    Spark repeats a derived column's expression in every filter above it, once per mention. What a
    generator gives is not repeated; this one gives one row per row, without a shuffle and inside
    generated code.
    """
    others = [name for name in frame.columns if name not in columns]
    return frame.select(*others, F.inline(F.array(F.struct(*columns))))
