"""Run registered queries against their SQL: python -m seqwatch.checks.compare <sf_dir> [query ...]"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

from seqwatch.checks.oracle import ORACLE
from seqwatch.checks.queries import QUERIES
from seqwatch.session import local_session

# Spark type -> DuckDB type.
TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def oracle_rows(connection, sql: str) -> tuple[dict[str, str], list[tuple]]:
    described = connection.execute(f"describe {sql}").fetchall()
    types = {row[0]: row[1] for row in described}
    names = [row[0] for row in described]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = connection.execute(sql).fetchall()
    return types, sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def spark_rows(frame) -> tuple[dict[str, str], list[tuple]]:
    types = {name: TYPES.get(kind, kind) for name, kind in frame.dtypes}
    rows = frame.select(*[f"`{name}`" for name in sorted(frame.columns)]).collect()
    return types, sorted((tuple(_plain(value) for value in row) for row in rows), key=repr)


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def main(sf_dir: str, names: list[str]) -> int:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    bad = 0
    for name in names or list(QUERIES):
        start = time.perf_counter()
        try:
            types, rows = spark_rows(QUERIES[name](spark, sf_dir))
            seconds = time.perf_counter() - start
            if name not in ORACLE:
                print(f"{name:30s} {len(rows):7d} rows, no SQL  {seconds:.2f}s")
                continue
            oracle_types, oracle = oracle_rows(connection, ORACLE[name])
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"{name:30s} FAILED {type(error).__name__}: {str(error)[:600]}")
            continue
        same = rows == oracle and types == oracle_types
        bad += not same
        print(f"{name:30s} {len(rows):7d} {'same' if same else 'DIFFERENT'}  {seconds:.2f}s")
        if not same:
            print("   types", types, oracle_types, "rows", len(rows), len(oracle))
            shown = [(a, b) for a, b in zip(rows, oracle) if a != b][:3]
            print("   ", *[f"{str(a)[:300]} | {str(b)[:300]}" for a, b in shown], sep="\n    ")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
