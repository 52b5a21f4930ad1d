"""Counts over case line lists.

All counts are partial aggregates before the shuffle, so a year or region that holds a third of all
cases sends one row per task like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from seqwatch.functions.cases import SEX_LABELS, age_group, blank_to_null, normalise_name, parse_date, sex_label, year_of
from seqwatch.operators.derived import computed_once


def blanks_to_null(table: DataFrame) -> DataFrame:
    """Empty text becomes NULL in every text column."""
    texts = {field.name for field in table.schema if isinstance(field.dataType, StringType)}
    return table.select(*[blank_to_null(F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in table.columns])


def with_notification_year(cases: DataFrame, date: str = "FEC_NOT", year: str = "year") -> DataFrame:
    """Replace the date text by the date and add its year. The year column of the list is another key."""
    if isinstance(cases.schema[date].dataType, StringType):
        dated = computed_once(cases.withColumn(date, parse_date(F.col(date))), date)
    else:
        dated = cases.withColumn(date, F.col(date).cast("date"))
    others = [name for name in cases.columns if name.lower() != year.lower()]
    return dated.select(*others, year_of(F.col(date)).alias(year))


def notified_between(cases: DataFrame, date: str, first: int, last: int) -> DataFrame:
    """The cases notified from the first to the last year, with the ``year``; cases without a date drop.

    The limits are dates, not years, so that they can be tested on a stored date column's statistics.
    """
    dated = with_notification_year(cases, date)
    start, end = F.make_date(F.lit(first), F.lit(1), F.lit(1)), F.make_date(F.lit(last), F.lit(12), F.lit(31))
    return dated.where(F.col(date).between(start, end))


def count_cases(cases: DataFrame, *keys) -> DataFrame:
    """Number of rows per key; a NULL key is a group of its own."""
    return cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("casos"))


def annual_cases(cases: DataFrame, year: str = "ANO") -> DataFrame:
    return count_cases(cases, year)


def cases_by_sex(cases: DataFrame, year: str = "ANO", sex: str = "SEXO") -> DataFrame:
    """Cases per year and sex, of the two known codes only, with the readable label."""
    known = cases.where(F.col(sex).isin(*SEX_LABELS))
    return count_cases(known, year, sex).withColumn("label", sex_label(F.col(sex)))


def cases_by_age_group(cases: DataFrame, year: str = "ANO", age: str = "EDAD", unknown_label: str | None = None) -> DataFrame:
    """Cases per year and age band; the count is also given as the double the charts plot."""
    band = age_group(F.col(age), unknown_label).alias("age_group")
    return count_cases(cases, year, band).withColumn("casos_plotted", F.col("casos").cast("double"))


def cases_by_region(
    cases: DataFrame,
    region: str = "Departamento_ocurrencia",
    by: Sequence[str] = (),
    normalise_first: bool = True,
) -> DataFrame:
    """Cases per region name, and per further keys.

    ``normalise_first=False`` counts the names as they are spelled and normalises the result, which
    leaves one row per spelling variant.
    """
    name = normalise_name(F.col(region)).alias(region)
    if normalise_first:
        return count_cases(cases, name, *by)
    return count_cases(cases, region, *by).select(name, *by, "casos")


def year_levels(cases: DataFrame, year: str = "ANO") -> DataFrame:
    """The years that occur, each with its place in their order. A missing year is no level.

    The window runs over the distinct years, not over the cases.
    """
    years = cases.where(F.col(year).isNotNull()).select(year).distinct()
    return years.withColumn("level", F.dense_rank().over(Window.orderBy(year)))


def distinct_values(table: DataFrame, *columns: str) -> DataFrame:
    return table.select(*columns).distinct()


def key_order(table: DataFrame, *keys: str) -> DataFrame:
    """Sort a result by its keys, missing keys last. For final output only."""
    return table.orderBy(*[F.col(key).asc_nulls_last() for key in keys])
