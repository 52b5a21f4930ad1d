"""Every registered query against its SQL."""

import importlib.util
from pathlib import Path

import pytest

from seqwatch.checks.compare import connect, oracle_rows, spark_rows
from seqwatch.checks.oracle import ORACLE
from seqwatch.checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    with connect(SF_DIR) as connection:
        yield connection


def test_every_query_has_its_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == oracle_rows(duck, ORACLE[name])


def test_contract(spark):
    path = Path(__file__).resolve().parent.parent / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("entry_module", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).columns == ["name", "year", "casos", "fill"]
    assert set(QUERIES) <= set(module.queries()) and set(ORACLE) <= set(module.oracle_sql()) <= set(module.queries())
