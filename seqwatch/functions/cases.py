"""Expressions on case line-list columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Age bands (inclusive upper limit, label), the catch-all band, and sex code labels.
AGE_BANDS = ((5, "0-5 years"), (17, "6-17 years"), (60, "18-60 years"))
OLDEST_BAND = "60+ years"
SEX_LABELS = {"M": "Male", "F": "Female"}

# Fixed value: the characters trimmed from both ends of a region name.
NAME_PADDING = " \t\r\n"

# yyyy-mm-dd at the start of the text, one-digit parts allowed, anything may follow. A day that cannot
# be two digits (first digit above 3) is read as one digit; a month or day out of range is not a date.
_DATE_PREFIX = r"^( *[0-9]{1,4}- *[01]?[0-9]- *[0-3]?[0-9])"


def blank_to_null(value: Column) -> Column:
    """The empty string becomes NULL; padded blanks stay as they are."""
    return F.nullif(value, F.lit(""))


def age_group(age: Column, unknown_label: str | None = None) -> Column:
    """Age band, first match wins.

    A missing age falls into the catch-all band, as in the published tables, unless ``unknown_label``
    gives it a band of its own.
    """
    (first_limit, first_label), *others = AGE_BANDS
    bands = F.when(age <= first_limit, first_label)
    for limit, label in others:
        bands = bands.when(age <= limit, label)
    if unknown_label is not None:
        bands = bands.when(age.isNull(), unknown_label)
    return bands.otherwise(OLDEST_BAND)


def normalise_name(name: Column) -> Column:
    """Trim blanks, tabs and line ends, then upper-case. Accents are kept."""
    return F.upper(F.btrim(name, F.lit(NAME_PADDING)))


def parse_date(text: Column) -> Column:
    """Leading year-month-day of a text as a date; NULL when there is none or it is not a real day."""
    digits = F.nullif(F.replace(F.regexp_extract(text, _DATE_PREFIX, 1), F.lit(" "), F.lit("")), F.lit(""))
    # A cast wants four digits of the year, and unlike a date pattern throws nothing for a wrong day.
    missing = F.lit(5) - F.instr(digits, "-")
    return F.concat(F.repeat(F.lit("0"), missing), digits).try_cast("date")


def year_of(date: Column) -> Column:
    return F.year(date)


def sex_label(code: Column) -> Column:
    """Readable label of a sex code; unknown codes pass through."""
    labels = F.create_map(*[F.lit(text) for pair in SEX_LABELS.items() for text in pair])
    return F.coalesce(F.try_element_at(labels, code), code)


def rescale(value: Column, low: Column, high: Column) -> Column:
    """Position of ``value`` between ``low`` and ``high`` (0 to 1); 0.5 where all values are equal."""
    position = F.try_divide((value - low).cast("double"), (high - low).cast("double"))
    return F.when(value.isNotNull(), F.coalesce(position, F.lit(0.5)))
