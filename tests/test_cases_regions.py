from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqwatch.operators import cases as ops
from seqwatch.operators.regions import join_counts, map_fill, region_years, unmatched_names
from seqwatch.plans.surveillance import case_tables, one_year_map, region_map, region_year_map

SCHEMA = "ANO int, SEXO string, EDAD double, FEC_NOT string, Departamento_ocurrencia string"
CASES = [
    (2010, "M", 5.0, "2010-01-02", "ANTIOQUIA"),
    (2010, "F", 5.5, "2010-01-02 00:00", "\tantioquia "),
    (2010, "F", None, "2009-12-31", "Antioquia"),
    (2011, "I", 61.0, "2011-1-5", "BOGOTÁ"),
    (2011, "", 60.0, "junk", ""),
    (2011, None, 17.0, None, None),
    (None, "M", -1.0, "2012-02-30", "bogotá"),
    (2012, "M", 18.0, "2012-02-29", "ELSEWHERE"),
]


@pytest.fixture
def cases(spark):
    return spark.createDataFrame(CASES, SCHEMA).repartition(3)


@pytest.fixture
def regions(spark):
    return spark.createDataFrame([(" Antioquia", "g1"), ("Bogotá", "g2"), ("Chocó", "g3")], "DPTO_CNMBR string, geometry string")


def rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def test_annual_cases_keep_the_missing_year(cases):
    assert rows(ops.annual_cases(cases)) == rows_of(Counter((row[0],) for row in CASES))


def rows_of(counter):
    return sorted((key + (n,) for key, n in counter.items()), key=repr)


def test_cases_by_sex_take_known_codes(cases):
    assert rows(ops.cases_by_sex(cases)) == sorted(
        [(2010, "M", 1, "Male"), (2010, "F", 2, "Female"), (None, "M", 1, "Male"), (2012, "M", 1, "Male")], key=repr
    )


def test_no_age_is_lost(cases):
    table = ops.cases_by_age_group(cases)
    assert table.agg(F.sum("casos")).first()[0] == len(CASES)
    assert (2010, "60+ years", 1, 1.0) in rows(table)
    assert (2010, "unknown", 1, 1.0) in rows(ops.cases_by_age_group(cases, unknown_label="unknown"))


def test_job_tables_equal_the_single_operators(cases):
    tables = case_tables(cases)
    cleaned = ops.blanks_to_null(cases)
    assert rows(tables.annual) == rows(ops.annual_cases(cleaned))
    assert rows(tables.by_sex) == rows(ops.cases_by_sex(cleaned))
    assert rows(tables.by_age_group) == rows(ops.cases_by_age_group(cleaned))


def test_both_orders_of_normalising(cases):
    assert ("ANTIOQUIA", 3) in rows(ops.cases_by_region(cases))
    as_written = rows(ops.cases_by_region(cases, normalise_first=False))
    assert as_written.count(("ANTIOQUIA", 1)) == 3
    assert sum(n for _, n in as_written) == len(CASES)


def test_region_map(cases, regions):
    assert rows(region_map(cases, regions)) == [
        ("ANTIOQUIA", "g1", 3, 1.0), ("BOGOTÁ", "g2", 2, 0.0), ("CHOCÓ", "g3", None, None),
    ]


def test_region_map_as_written_fans_out(cases, regions):
    table = region_map(cases, regions, normalise_first=False).drop("fill")
    assert rows(table) == [("ANTIOQUIA", "g1", 1)] * 3 + [("BOGOTÁ", "g2", 1)] * 2 + [("CHOCÓ", "g3", None)]


def test_one_year_map(cases, regions):
    table = one_year_map(cases, regions, 2010).drop("geometry")
    assert rows(table) == [("ANTIOQUIA", 2, 0.5), ("BOGOTÁ", None, None), ("CHOCÓ", None, None)]


def test_region_year_map_has_every_region_in_every_year(cases, regions):
    table = region_year_map(cases, regions, 2009, 2013)
    assert table.columns == ["DPTO_CNMBR", "geometry", "year", "casos", "fill"]
    counted = {(row.DPTO_CNMBR, row.year): row.casos for row in table.collect()}
    assert len(counted) == table.count() == 3 * 5
    assert {key: n for key, n in counted.items() if n} == {
        ("ANTIOQUIA", 2009): 1, ("ANTIOQUIA", 2010): 2, ("BOGOTÁ", 2011): 1,
    }


def test_region_year_map_default_years_and_columns(cases, regions):
    table = region_year_map(cases, regions, carry=[])
    assert table.columns == ["DPTO_CNMBR", "year", "casos", "fill"]
    assert sorted({row.year for row in table.collect()}) == list(range(2007, 2024))
    assert table.count() == 3 * 17


def test_stored_dates_give_the_same_map(cases, regions):
    stored = ops.with_notification_year(cases).drop("year")
    assert rows(region_year_map(stored, regions, 2009, 2012)) == rows(region_year_map(cases, regions, 2009, 2012))


def test_a_year_column_of_the_list_is_another_key(cases, regions):
    listed = cases.withColumn("Year", F.lit(1999))
    assert rows(region_year_map(listed, regions, 2009, 2012)) == rows(region_year_map(cases, regions, 2009, 2012))


def test_null_keys_meet_on_request(spark):
    regions = spark.createDataFrame([("A",), (None,)], "DPTO_CNMBR string")
    counts = spark.createDataFrame([("A", 1), (None, 2)], "Departamento_ocurrencia string, casos bigint")
    assert rows(join_counts(regions, counts)) == [("A", 1), (None, None)]
    assert rows(join_counts(regions, counts, null_safe=True)) == [("A", 1), (None, 2)]


def test_unmatched_names(cases, regions):
    assert rows(unmatched_names(cases, regions)) == sorted(
        [("", "cases"), (None, "cases"), ("ELSEWHERE", "cases"), ("CHOCÓ", "regions")], key=repr
    )


def test_unnamed_on_both_sides_is_unmatched_on_both(spark):
    cases = spark.createDataFrame([(None,), ("a",)], "Departamento_ocurrencia string")
    regions = spark.createDataFrame([(None,), ("A",)], "DPTO_CNMBR string")
    assert rows(unmatched_names(cases, regions)) == [(None, "cases"), (None, "regions")]


def test_year_levels(cases):
    assert rows(ops.year_levels(cases)) == [(2010, 1), (2011, 2), (2012, 3)]


def test_key_order_puts_missing_keys_last(cases):
    ordered = ops.key_order(ops.annual_cases(cases), "ANO").collect()
    assert [row.ANO for row in ordered] == [2010, 2011, 2012, None]


def test_fill_per_map_and_over_all(spark):
    data = [(1, "a", 2), (1, "b", 4), (1, "c", None), (2, "a", 7), (2, "b", None), (3, "a", None), (None, "a", 1), (None, "b", 3)]
    frame = spark.createDataFrame(data, "year int, name string, casos bigint")
    per_map = {(row.year, row.name): row.fill for row in map_fill(frame, ["year"]).collect()}
    assert per_map == {
        (1, "a"): 0.0, (1, "b"): 1.0, (1, "c"): None, (2, "a"): 0.5, (2, "b"): None, (3, "a"): None, (None, "a"): 0.0, (None, "b"): 1.0,
    }
    whole = {(row.year, row.name): row.fill for row in map_fill(frame).collect()}
    assert whole[(2, "a")] == 1.0 and whole[(None, "a")] == 0.0 and whole[(1, "b")] == 0.5


def test_years_of_each_region(regions):
    assert region_years(regions, 2020, 2021).count() == 6
