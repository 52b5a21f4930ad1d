import random

from pyspark.sql import functions as F

from seqwatch.operators import sketches
from seqwatch.operators.profile import QUARTILES, column_profile

NUMBERS = "year int, a double, b bigint, c string"


def rows_of(seed, years, n):
    rng = random.Random(seed)
    return [(y, rng.choice([None, float("nan"), rng.gauss(y, 10)]) if rng.random() < 0.1 else rng.gauss(y, 10), rng.randrange(50), "x") for y in years for _ in range(n)]


def near(values, quartile, share, k=sketches.K):
    below, up_to = sum(v < quartile for v in values) / len(values), sum(v <= quartile for v in values) / len(values)
    return below - 3 * sketches.rank_error(k) <= share <= up_to + 3 * sketches.rank_error(k)


def test_merged_sketches_equal_the_exact_profile(spark):
    rows = rows_of(1, range(2007, 2012), 3000)
    table = spark.createDataFrame(rows, NUMBERS)
    merged = sketches.sketched_profile(sketches.merge_sketches(sketches.column_sketches(table, ["year"])))
    found = {r.column: r for r in merged.collect()}
    exact = {r.column: r for r in column_profile(table.select("a", "b")).collect()}
    assert set(found) == {"a", "b"}
    for c, values in (("a", [r[1] for r in rows if r[1] is not None and r[1] == r[1]]), ("b", [r[2] for r in rows])):
        assert all(abs(found[c][m] - exact[c][m]) < 1e-9 * abs(exact[c][m]) + 1e-9 for m in ("n", "missing", "min", "max", "mean"))
        assert all(near(values, found[c][q], share) for q, share in QUARTILES.items())


def test_parts_without_values(spark):
    table = spark.createDataFrame([(2007, None, None, "x"), (2007, float("nan"), None, "x"), (2008, 1.0, 5, "y")], NUMBERS)
    parts = {(r.year, r.column): r for r in sketches.sketched_profile(sketches.column_sketches(table, ["year"])).collect()}
    assert (parts[2007, "a"].n, parts[2007, "a"].missing, parts[2007, "a"].median, parts[2007, "a"].mean) == (2, 2, None, None)
    assert (parts[2008, "a"].median, parts[2008, "b"].q1, parts[2008, "b"].mean) == (1.0, 5.0, 5.0)
    merged = {r.column: r for r in sketches.sketched_profile(sketches.merge_sketches(sketches.column_sketches(table, ["year"]))).collect()}
    assert (merged["a"].n, merged["a"].missing, merged["a"].median, merged["b"].max) == (3, 2, 1.0, 5.0)
    only = table.where("year = 2007")
    none = {r.column: r for r in sketches.sketched_profile(sketches.merge_sketches(sketches.column_sketches(only, ["year"]))).collect()}
    assert none["a"].median is None and none["a"].n == 2
    assert sketches.column_sketches(table.limit(0), ["year"]).collect() == []


def test_an_added_year_is_all_that_is_read(spark, tmp_path):
    path = str(tmp_path / "sketches")
    first = spark.createDataFrame(rows_of(2, (2007, 2008), 500), NUMBERS)
    sketches.add_to_sketches(first, path, ["year"])
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "sketches").rglob("*.parquet")}
    added = sketches.add_to_sketches(spark.createDataFrame(rows_of(3, (2009,), 500), NUMBERS), path, ["year"])
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "sketches").rglob("*.parquet")}
    assert before.items() < after.items()
    merged = sketches.merge_sketches(added).where(F.col("column") == "b").first()
    assert merged.n == 1500
    # A year that comes again takes the place of the old one.
    again = sketches.add_to_sketches(spark.createDataFrame(rows_of(4, (2009,), 20), NUMBERS), path, ["year"])
    assert sketches.merge_sketches(again).where(F.col("column") == "b").first().n == 1020


def test_more_values_are_more_exact():
    assert sketches.rank_error(800) < 0.004 < sketches.rank_error(200) < 0.015
