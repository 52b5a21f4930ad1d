"""Joins of case counts to regions and the values of a choropleth.

Counts are one row per region name and carry no broadcast hint: adaptive execution broadcasts them when
their measured size is below the session's limit and shuffles them otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqwatch.functions.cases import normalise_name, rescale

# First and last year of the yearly maps.
FIRST_YEAR, LAST_YEAR = 2007, 2023


def normalise_column(table: DataFrame, name: str) -> DataFrame:
    return table.withColumn(name, normalise_name(F.col(name)))


def join_counts(
    regions: DataFrame,
    counts: DataFrame,
    name: str = "DPTO_CNMBR",
    region: str = "Departamento_ocurrencia",
    by: Sequence[str] = (),
    null_safe: bool = False,
) -> DataFrame:
    """Every region with its count; NULL, not 0, where there is none.

    ``null_safe=True`` lets an unnamed region meet the cases without a region name.
    """
    left, right = regions.alias("regions"), counts.alias("counts")
    names = F.col(f"regions.{name}"), F.col(f"counts.{region}")
    condition = names[0].eqNullSafe(names[1]) if null_safe else names[0] == names[1]
    for key in by:
        condition = condition & (F.col(f"regions.{key}") == F.col(f"counts.{key}"))
    return left.join(right, condition, "left").select("regions.*", "counts.casos")


def region_years(regions: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """Every region once per year: each row is expanded in place, nothing is joined."""
    return regions.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))


def unmatched_names(cases: DataFrame, regions: DataFrame, region: str = "Departamento_ocurrencia", name: str = "DPTO_CNMBR") -> DataFrame:
    """Normalised names that stand on one side only, and which side. A missing name matches nothing."""
    in_cases = cases.select(normalise_name(F.col(region)).alias("case_name")).distinct()
    in_regions = regions.select(normalise_name(F.col(name)).alias("region_name")).distinct()
    one_sided = in_cases.withColumn("in_cases", F.lit(True)).join(
        in_regions.withColumn("in_regions", F.lit(True)), F.col("case_name") == F.col("region_name"), "full"
    )
    return one_sided.where("in_cases is null or in_regions is null").select(
        F.coalesce("case_name", "region_name").alias("name"),
        F.when(F.col("in_cases"), "cases").otherwise("regions").alias("side"),
    )


def map_fill(table: DataFrame, by: Sequence[str] = (), value: str = "casos", few_maps: bool = False) -> DataFrame:
    """Place of each count between the lowest and the highest of its map (0 to 1), NULL without a count.

    The limits are one aggregated row per map, fetched as a scalar or joined on ``by``; no window
    gathers the map's rows, with their geometries, in one task. ``few_maps`` says that the caller bounds the number of
    maps; the limits are then broadcast and the rows stay where they are.
    """
    limits = F.min(value).alias("low"), F.max(value).alias("high")
    if not by:
        limit_pair = table.agg(F.struct(*limits).alias("limits")).scalar()
        return _filled(table.withColumn("limits", limit_pair), table.columns, value)
    per_map = table.groupBy(*by).agg(F.struct(*limits).alias("limits")).alias("m")
    condition = F.lit(True)
    for key in by:
        condition = condition & F.col(f"t.{key}").eqNullSafe(F.col(f"m.{key}"))
    joined = table.alias("t").join(F.broadcast(per_map) if few_maps else per_map, condition, "left").select("t.*", "m.limits")
    return _filled(joined, table.columns, value)


def _filled(table: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    fill: Column = rescale(F.col(value), F.col("limits.low"), F.col("limits.high"))
    return table.select(*columns, fill.alias("fill"))
