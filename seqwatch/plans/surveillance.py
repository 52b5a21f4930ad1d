"""Case surveillance: tables by year, sex, age and region, and the data of the maps."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from seqwatch.functions.cases import SEX_LABELS, age_group, sex_label
from seqwatch.operators.cases import blanks_to_null, cases_by_region, count_cases, notified_between
from seqwatch.operators.regions import FIRST_YEAR, LAST_YEAR, join_counts, map_fill, normalise_column, region_years


class CaseTables(NamedTuple):
    """The yearly tables, and the counts they are summed from."""

    annual: DataFrame
    by_sex: DataFrame
    by_age_group: DataFrame
    counts: DataFrame


def case_tables(
    cases: DataFrame, year: str = "ANO", sex: str = "SEXO", age: str = "EDAD", unknown_label: str | None = None
) -> CaseTables:
    """Cases per year, per year and sex, per year and age band, from one pass over the cases.

    The cases are counted by all three keys; each table is a sum over these few rows. Used together, the tables
    share that count; to write them one by one, store or persist ``counts`` first.
    """
    band = age_group(F.col(age), unknown_label).alias("age_group")
    counts = count_cases(blanks_to_null(cases), year, sex, band)

    def summed(table: DataFrame, *keys: str) -> DataFrame:
        return table.groupBy(*keys).agg(F.sum("casos").alias("casos"))

    by_sex = summed(counts.where(F.col(sex).isin(*SEX_LABELS)), year, sex)
    return CaseTables(
        summed(counts, year),
        by_sex.withColumn("label", sex_label(F.col(sex))),
        summed(counts, year, "age_group").withColumn("casos_plotted", F.col("casos").cast("double")),
        counts,
    )


def region_map(
    cases: DataFrame,
    regions: DataFrame,
    region: str = "Departamento_ocurrencia",
    name: str = "DPTO_CNMBR",
    normalise_first: bool = True,
    null_safe: bool = False,
) -> DataFrame:
    """Every region with its cases over all years and its place on the colour scale."""
    counts = cases_by_region(cases, region, (), normalise_first)
    return map_fill(join_counts(normalise_column(regions, name), counts, name, region, (), null_safe))


def one_year_map(
    cases: DataFrame,
    regions: DataFrame,
    year: int,
    region: str = "Departamento_ocurrencia",
    name: str = "DPTO_CNMBR",
    date: str = "FEC_NOT",
    normalise_first: bool = True,
) -> DataFrame:
    """Every region with the cases notified in one year."""
    of_year = notified_between(cases, date, year, year)
    return region_map(of_year, regions, region, name, normalise_first)


def region_year_map(
    cases: DataFrame,
    regions: DataFrame,
    first: int = FIRST_YEAR,
    last: int = LAST_YEAR,
    region: str = "Departamento_ocurrencia",
    name: str = "DPTO_CNMBR",
    date: str = "FEC_NOT",
    normalise_first: bool = True,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Every region in every year, with its cases and its place on that year's colour scale.

    One pass over the cases for all years. ``carry`` names the region columns wanted in the result
    (all by default): leave the geometry out and it is not repeated per year.
    """
    named = normalise_column(regions if carry is None else regions.select(*dict.fromkeys([name, *carry])), name)
    in_range = notified_between(cases, date, first, last)
    counts = cases_by_region(in_range, region, ["year"], normalise_first)
    table = join_counts(region_years(named, first, last), counts, name, region, ["year"])
    return map_fill(table, ["year"], few_maps=True)  # as many as years asked for
