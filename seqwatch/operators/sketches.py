"""Profiles of number columns that can be merged: one small row per column and part of the data.

Where ``column_profile`` is exact and reads everything, these are quantile sketches. A year that is
added is sketched by itself, and the profile of all years comes from the sketches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from seqwatch.operators.profile import QUARTILES, _without_nan

#: Values a sketch keeps per level: more are more exact.
K = 800


def rank_error(k: int = K) -> float:
    """How far a value's share of smaller ones may be from the one asked for, in 99 of 100 cases; as the sketch's authors state it."""
    return 2.296 / k**0.9723


def column_sketches(table: DataFrame, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """by, column, n, missing, low, high, total, sketch: a row per number column for each part of the table, in one pass.

    NaN counts as missing. A part without values has a row without a sketch.
    """
    numbers = [field.name for field in table.schema if isinstance(field.dataType, NumericType) and field.name not in by]
    clean = _without_nan(table.select(*by, *[F.col(f"`{c}`").cast("double").alias(c) for c in numbers]))
    measures: list[Column] = [F.count(F.lit(1)).alias("n")]
    for c in numbers:
        value = F.col(f"`{c}`")
        parts = {"n": F.count(value), "low": F.min(value), "high": F.max(value), "total": F.sum(value), "sketch": F.kll_sketch_agg_double(value, F.lit(k))}
        measures += [part.alias(f"{c}:{name}") for name, part in parts.items()]
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col("n"), (F.col("n") - F.col(f"`{c}:n`")).alias("missing"), *[F.col(f"`{c}:{m}`").alias(m) for m in ("low", "high", "total")],
            F.when(F.col(f"`{c}:n`") > 0, F.col(f"`{c}:sketch`")).alias("sketch"),
        )
        for c in numbers
    ]
    return clean.groupBy(*by).agg(*measures).select(*by, F.inline(F.array(*rows)))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of parts as those of larger parts, or of everything."""
    return sketches.groupBy(*by, "column").agg(
        F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def sketched_profile(sketches: DataFrame) -> DataFrame:
    """n, missing, min, quartiles, mean and max, as ``column_profile`` has them; the quartiles within ``rank_error`` of their ranks."""
    present = (F.col("n") - F.col("missing")) > 0
    quartiles = [F.when(present, F.kll_sketch_get_quantile_double("sketch", F.lit(share))).alias(name) for name, share in QUARTILES.items()]
    mean = F.when(present, F.col("total") / (F.col("n") - F.col("missing"))).alias("mean")
    others = [c for c in sketches.columns if c not in ("n", "missing", "low", "high", "total", "sketch", "column")]
    return sketches.select(*others, "column", "n", "missing", F.col("low").alias("min"), *quartiles, mean, F.col("high").alias("max"))


def add_to_sketches(table: DataFrame, path: str, by: Sequence[str], k: int = K) -> DataFrame:
    """Sketch new parts into the table at ``path``, and return it: the parts that are there already are not read again, but replaced if they come again."""
    writer = column_sketches(table, by, k).write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite")
    writer.parquet(path)
    return table.sparkSession.read.parquet(path)
