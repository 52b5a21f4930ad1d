"""First look at a table: preview, structure, and a per-column profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from seqwatch.session import ensure_checkpoint_dir

# Fixed value: rows of a preview.
PREVIEW_ROWS = 6

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def preview(table: DataFrame, order_by: Sequence[str] = (), n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows."""
    return (table.orderBy(*order_by) if order_by else table).limit(n)


def structure(table: DataFrame, order_by: Sequence[str] = (), n: int = PREVIEW_ROWS) -> DataFrame:
    """One row per column: its type and its values in the first rows."""
    first = preview(table, order_by, n).select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")).alias(c) for c in table.columns]
    )
    lists = first.agg(*[F.collect_list(f"`{c}`").alias(c) for c in table.columns])
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(kind).alias("type"), F.array_join(f"`{c}`", " ").alias("first_values"))
        for c, kind in table.dtypes
    ]
    return lists.select(F.inline(F.array(*rows)))


def column_profile(table: DataFrame) -> DataFrame:
    """Rows, missing values, minimum, quartiles, mean and maximum of every column.

    Quartiles are interpolated between the two neighbouring values; numbers are taken as doubles, so
    whole numbers beyond 2^53 are rounded. Columns that are not numbers have rows and missing values
    only. NaN counts as missing.

    The built-in exact percentile gathers a column's distinct values in one task. Here the distinct
    values of all columns, with their counts, are sorted together into ranges, one task each. The
    ranges' totals say in which of them a wanted rank lies, and only these, six per column at most, are counted
    through. Two jobs, whatever the values: the ranges are kept at checkpoints, taken when the function is called.
    """
    numbers = [field.name for field in table.schema if isinstance(field.dataType, NumericType)]
    cleaned = _without_nan(table)
    if not numbers:
        return _basics(cleaned, numbers).drop("number")

    ensure_checkpoint_dir(table.sparkSession)
    basics = _basics(cleaned, numbers).checkpoint()
    ranges = value_ranges(cleaned, numbers)
    picked = _at_ranks(ranges, _wanted_ranks(basics))
    quartiles = picked.groupBy("number").agg(*[_interpolated(name).alias(name) for name in QUARTILES])
    columns = [name for name in basics.columns if name != "number"]
    # One row per column of the table on both sides.
    return basics.drop(*QUARTILES).join(F.broadcast(quartiles), "number", "left").select(*columns)


def value_ranges(table: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """The distinct values of the number columns, how often each occurs, and the range of the common order it is in."""
    pairs = [item for number, name in enumerate(numbers) for item in (F.lit(number), F.col(f"`{name}`").cast("double"))]
    values = table.select(F.stack(F.lit(len(numbers)), *pairs).alias("number", "value")).where("value is not null")
    # Counted first: a frequent value is one row from here on, and ranges of distinct values are even. Kept, as ranges are chosen from a sample.
    counted = values.groupBy("number", "value").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    return counted.repartitionByRange("number", "value").withColumn("range", F.spark_partition_id()).checkpoint()


def _without_nan(table: DataFrame) -> DataFrame:
    fractional = [field.name for field in table.schema if isinstance(field.dataType, (DoubleType, FloatType))]
    return table.withColumns({name: F.when(~F.isnan(f"`{name}`"), F.col(f"`{name}`")) for name in fractional})


def _basics(table: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """Everything but the quartiles, in one pass over the table. Number columns are numbered."""
    measures = {"min": F.min, "mean": F.avg, "max": F.max}
    present = [F.count(f"`{c}`").alias(f"{c}:n") for c in table.columns]
    limits = [measure(f"`{c}`").cast("double").alias(f"{c}:{name}") for c in numbers for name, measure in measures.items()]
    totals = table.agg(F.count(F.lit(1)).alias("n"), *present, *limits)
    absent = F.lit(None).cast("double")

    def row(name: str, kind: str) -> Column:
        measured = {m: F.col(f"`{name}:{m}`") if name in numbers else absent for m in measures}
        return F.struct(
            F.lit(numbers.index(name) if name in numbers else None).cast("int").alias("number"),
            F.lit(name).alias("column"),
            F.lit(kind).alias("type"),
            F.col("n"),
            (F.col("n") - F.col(f"`{name}:n`")).alias("missing"),
            measured["min"].alias("min"),
            absent.alias("q1"),
            absent.alias("median"),
            measured["mean"].alias("mean"),
            absent.alias("q3"),
            measured["max"].alias("max"),
        )

    return totals.select(F.inline(F.array(*[row(name, kind) for name, kind in table.dtypes])))


def _wanted_ranks(basics: DataFrame) -> DataFrame:
    """Per number column and quartile the two neighbouring ranks, counted from 1 in sorted order."""
    columns = basics.withColumn("n_within", F.col("n") - F.col("missing")).where("n_within > 0")
    wanted = []
    for name, share in QUARTILES.items():
        place = (F.col("n_within") - 1) * F.lit(share)
        for side, rank in (("left", F.floor(place)), ("right", F.ceil(place))):
            wanted.append(
                F.struct(
                    F.lit(name).alias("quartile"),
                    F.lit(side).alias("side"),
                    (rank + 1).alias("rank"),
                    (place - F.floor(place)).alias("weight"),
                )
            )
    return columns.select("number", F.inline(F.array(*wanted)))


def _at_ranks(ranges: DataFrame, ranks: DataFrame) -> DataFrame:
    """The value at each rank. Ranks are six per column, so broadcasting them is safe."""
    totals = ranges.groupBy("number", "range").agg(F.sum("n").alias("n_range"))
    up_to = F.sum("n_range").over(Window.partitionBy("number").orderBy("range"))
    totals = totals.withColumn("n_before", up_to - F.col("n_range")).withColumn("n_to", up_to)
    holds = F.col("rank").between(F.col("n_before") + 1, F.col("n_to"))
    sought = totals.join(F.broadcast(ranks), "number").where(holds).drop("n_range", "n_to")
    # A few ranges per column are gone through; no other row is moved.
    places = F.broadcast(sought.select("number", "range", "n_before").distinct())
    counted_to = F.sum("n").over(Window.partitionBy("number", "range").orderBy("value"))
    counted = ranges.join(places, ["number", "range"]).withColumn("n_to", F.col("n_before") + counted_to).drop("n_before")
    found = counted.join(F.broadcast(sought), ["number", "range"])
    return found.where(F.col("rank").between(F.col("n_to") - F.col("n") + 1, F.col("n_to")))


def _interpolated(quartile: str) -> Column:
    def at(side: str) -> Column:
        return F.max(F.when((F.col("quartile") == quartile) & (F.col("side") == side), F.col("value")))

    weight = F.max(F.when(F.col("quartile") == quartile, F.col("weight")))
    between = at("left") + (at("right") - at("left")) * weight
    return F.when(at("left") == at("right"), at("left")).otherwise(between)
