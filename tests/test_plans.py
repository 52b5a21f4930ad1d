"""Checks on physical plans: what moves, what is read, and where it runs."""

import re

import pytest
from pyspark.sql import functions as F

from seqwatch.checks.queries import QUERIES
from seqwatch.checks.standins import cases, regions, table
from seqwatch.operators import cases as case_ops
from seqwatch.operators import sequences
from seqwatch.operators.fetches import first_success, number_attempts
from seqwatch.plans.curation import curate, search_listings
from seqwatch.operators.sequences import to_dna
from seqwatch.plans.surveillance import region_year_map
from seqwatch.sources.fasta import read_fasta

SF_DIR = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def final_plan(frame):
    frame.collect()
    return plan(frame).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", [name for name in QUERIES if name not in ("column_profile",)])
def test_no_python_in_any_plan(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert not re.search(r"Python|MapInPandas|MapInArrow|CartesianProduct|NestedLoop", text)


# A window definition that starts with its order has no partition keys.
UNPARTITIONED = r"windowspecdefinition\([^,()]* (ASC|DESC)"


@pytest.mark.parametrize("name", [name for name in QUERIES if name not in ("column_profile", "year_levels")])
def test_no_window_over_everything(spark, name):
    assert not re.search(UNPARTITIONED, plan(QUERIES[name](spark, SF_DIR)))


def test_levels_are_numbered_on_the_distinct_years(spark):
    text = plan(QUERIES["year_levels"](spark, SF_DIR))
    window = re.search(UNPARTITIONED, text)
    assert window and "HashAggregate(keys=[ano" in text[window.end() :]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Small stored tables, so that scans show what is pushed down."""
    folder = str(tmp_path_factory.mktemp("stored"))
    cases(spark, SF_DIR).write.parquet(f"{folder}/cases")
    log = [(str(i % 7), i // 7 + 1, 200 if i % 3 else 503, f">{i} DENV2, complete genome") for i in range(100)]
    spark.createDataFrame(log, "id string, attempt int, status int, body string").write.parquet(f"{folder}/log")
    return folder


def test_membership_reaches_the_scan(spark, stored):
    text = plan(case_ops.cases_by_sex(spark.read.parquet(f"{stored}/cases"), "ano", "sexo"))
    assert "PushedFilters: [In(sexo, [F,M])]" in text
    assert "ReadSchema: struct<ano:int,sexo:string>" in text


def test_yearly_maps_read_the_cases_once_and_only_the_wanted_years(spark, stored):
    frame = region_year_map(
        spark.read.parquet(f"{stored}/cases"), regions(spark, SF_DIR), 1994, 1996, "dept", "name", "fec_not"
    )
    text = final_plan(frame)
    scans = re.findall(r"FileScan parquet \[[^\]]*dept[^\n]*", text)
    assert len(scans) == 1, text
    assert "GreaterThanOrEqual(fec_not,1994-01-01)" in scans[0] and "LessThanOrEqual(fec_not,1996-12-31)" in scans[0]
    assert "ReadSchema: struct<fec_not:date,dept:string>" in scans[0]


def test_counts_are_partial_before_the_shuffle(spark, stored):
    text = plan(case_ops.cases_by_region(spark.read.parquet(f"{stored}/cases"), "dept"))
    below = text[text.index("Exchange") :]
    assert "partial_count" in below and "SortAggregate" not in text


def test_filters_do_not_shuffle(spark, stored):
    log = spark.read.parquet(f"{stored}/log")
    for frame in (
        sequences.match_serotypes(log),
        sequences.filter_ambiguous(log, sequence="body"),
        sequences.purge(log, "body"),
        sequences.keep_serotype(log, "DENV2"),
    ):
        assert "Exchange" not in plan(frame)


def test_curation_counts_move_no_bodies(spark, stored):
    text = plan(curate(spark.read.parquet(f"{stored}/log")).stats)
    assert "SortAggregate" not in text
    assert not re.search(r"min_by\(body", text)


def test_kept_documents_come_from_successes_only(spark, stored):
    text = plan(curate(spark.read.parquet(f"{stored}/log")).kept)
    assert "EqualTo(status,200)" in text and "LessThanOrEqual(attempt,5)" in text


def test_bodies_are_neither_sorted_nor_aggregated(spark, stored):
    """The winning tries are known before a body moves, and then it moves once."""
    log = spark.read.parquet(f"{stored}/log")
    for frame in (first_success(log), curate(log).kept):
        text = plan(frame)
        assert "SortAggregate" not in text and not re.search(r"min_by\(body", text)
        for line in text.splitlines():
            if re.search(r"(Sort|Aggregate)\W", line):
                assert "body" not in line, line


def test_a_search_is_read_and_parsed_once(spark, tmp_path):
    spark.createDataFrame([(0, '{"esearchresult":{"idlist":["1"]}}')], "retstart int, body string").write.parquet(str(tmp_path / "r"))
    text = final_plan(search_listings(spark.read.parquet(str(tmp_path / "r"))))
    assert "FileScan" not in text and "from_json" not in text, text


def test_all_serotypes_take_one_scan(spark, stored):
    text = plan(sequences.match_serotypes(spark.read.parquet(f"{stored}/log")))
    assert len(re.findall("FileScan", text)) == 1


def test_case_tables_share_one_count(spark, stored):
    from seqwatch.checks.queries import _one_table
    from seqwatch.plans.surveillance import case_tables

    text = final_plan(_one_table(case_tables(spark.read.parquet(f"{stored}/cases"), "ano", "sexo", "edad")))
    assert "InMemoryTableScan" not in text


def test_yearly_limits_are_broadcast(spark, stored):
    areas = regions(spark, SF_DIR).withColumn("geometry", F.concat(F.lit("geometry of "), "name"))
    frame = region_year_map(spark.read.parquet(f"{stored}/cases"), areas, 1994, 1996, "dept", "name", "fec_not")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(frame)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in text
    assert not re.search(r"hashpartitioning\(year#\d+, \d+\)", text.split("BroadcastExchange")[0]), text


def test_unused_values_are_not_moved(spark, stored):
    text = plan(first_success(spark.read.parquet(f"{stored}/log")).select("id", "attempt"))
    assert "body" not in text


def test_attempts_are_limited_before_the_shuffle(spark):
    events = table(spark, SF_DIR, "events")
    text = plan(number_attempts(events, ["ts", "event_id"], "user_id"))
    assert re.search(r"WindowGroupLimit.*Final.*Exchange.*WindowGroupLimit.*Partial", text, re.S)


def test_flags_stay_in_generated_code(spark, stored):
    text = final_plan(sequences.match_serotypes(spark.read.parquet(f"{stored}/log")))
    for line in text.splitlines():
        if re.search(r"(Project|Generate|Filter) ", line):
            assert re.search(r"\*\(\d+\)", line), line


def test_derived_text_is_computed_once(spark, tmp_path):
    """However often a filter mentions a parsed sequence, the file's text is split once."""
    (tmp_path / "a.fasta").write_text(">A\nACGT\n")
    records = read_fasta(spark, str(tmp_path))
    for frame in (to_dna(sequences.purge(records)), sequences.filter_ambiguous(records, 0.5)):
        assert plan(frame).count("array_join(") == plan(records).count("array_join(")
