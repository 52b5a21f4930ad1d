import math
import random

import numpy as np
import pytest

from seqwatch.operators import profile
from seqwatch.operators.profile import column_profile, preview, structure


def expected(values):
    present = [v for v in values if v is not None and not math.isnan(v)]
    quartiles = np.quantile(present, [0.25, 0.5, 0.75]) if present else [None] * 3
    return {
        "n": len(values),
        "missing": len(values) - len(present),
        "min": min(present, default=None),
        "max": max(present, default=None),
        "mean": sum(present) / len(present) if present else None,
        "q1": quartiles[0],
        "median": quartiles[1],
        "q3": quartiles[2],
    }


def close(a, b):
    if a is None or b is None:
        return a is b
    return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


def columns(rng, n):
    return {
        "uniform": [rng.random() for _ in range(n)],
        "whole": [float(rng.randint(-50, 50)) for _ in range(n)],
        "ties": [rng.choice([1.0, 1.0, 1.0, 2.0]) for _ in range(n)],
        "constant": [3.5] * n,
        "far_out": [rng.random() if i else 1e300 for i in range(n)],
        "both_far": [-1.7e308, 1.7e308] + [rng.gauss(0, 1) for _ in range(n - 2)],
        "gaps": [None if rng.random() < 0.3 else rng.gauss(1e9, 1) for _ in range(n)],
        "nans": [float("nan") if rng.random() < 0.3 else rng.random() for _ in range(n)],
        "none": [None] * n,
        "one": [7.0] + [None] * (n - 1),
    }


def test_against_numpy(spark):
    data = columns(random.Random(3), 501)
    frame = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{name} double" for name in data)).repartition(4)
    profiled = {row["column"]: row for row in column_profile(frame).collect()}
    assert list(profiled) == list(data)
    for name, values in data.items():
        for measure, value in expected(values).items():
            if name == "both_far" and measure == "mean":
                continue
            assert close(profiled[name][measure], value), (name, measure, profiled[name][measure], value)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9])
def test_small_numbers_of_rows(spark, n):
    values = [float(v) for v in random.Random(n).sample(range(100), n)]
    row = column_profile(spark.createDataFrame([(v,) for v in values], "v double")).first()
    assert [row.q1, row.median, row.q3] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])))


def test_infinities(spark):
    values = [float("-inf"), 1.0, 2.0, 3.0, float("inf")]
    row = column_profile(spark.createDataFrame([(v,) for v in values], "v double")).first()
    assert [row.min, row.q1, row.median, row.q3, row.max] == [float("-inf"), 1.0, 2.0, 3.0, float("inf")]


def test_wide_ranging_values_take_as_many_jobs_as_others(spark):
    """Log-uniform values over 600 powers of ten: no range is larger than its share, and the jobs are those of narrow values."""

    def jobs(frame):
        before = len(tracker.getJobIdsForGroup("profile"))
        spark.sparkContext.setJobGroup("profile", "profile")
        row = column_profile(frame).first()
        spark.sparkContext.setJobGroup("other", "other")
        return row, len(tracker.getJobIdsForGroup("profile")) - before

    tracker = spark.sparkContext.statusTracker()
    rng = random.Random(9)
    wide = [10.0 ** rng.uniform(-300, 300) for _ in range(40_000)]
    frames = [spark.createDataFrame([(v,) for v in values], "v double") for values in (wide, [float(i % 100) for i in range(40_000)])]
    row, n_wide = jobs(frames[0])
    assert [row.q1, row.median, row.q3] == pytest.approx(list(np.quantile(wide, [0.25, 0.5, 0.75])), rel=1e-9)
    assert abs(n_wide - jobs(frames[1])[1]) <= 2
    # At this size adaptive execution would put all ranges together.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in profile.value_ranges(frames[0], ["v"]).groupBy("range").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 0.4 * len(wide)


def test_a_frequent_value_is_one_row(spark):
    frame = spark.range(10_000).selectExpr("case when id % 3 = 0 then 7D else cast(id as double) end as v")
    ranges = profile.value_ranges(frame, ["v"])
    assert [row.n for row in ranges.where("value = 7").collect()] == [3335]
    values = [7.0 if i % 3 == 0 else float(i) for i in range(10_000)]
    row = column_profile(frame).first()
    assert [row.q1, row.median, row.q3] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])))


def test_other_types(spark):
    frame = spark.createDataFrame([(1, "x", True), (None, "", None), (4, None, None)], "n int, `a b` string, flag boolean")
    rows = {row["column"]: row for row in column_profile(frame).collect()}
    assert (rows["n"].type, rows["n"].n, rows["n"].missing, rows["n"].median) == ("int", 3, 1, 2.5)
    assert (rows["a b"].n, rows["a b"].missing, rows["a b"].median) == (3, 1, None)
    assert (rows["flag"].type, rows["flag"].missing) == ("boolean", 2)


def test_text_only_and_empty_tables(spark):
    assert column_profile(spark.createDataFrame([("x",)], "a string")).first().n == 1
    row = column_profile(spark.createDataFrame([], "v double")).first()
    assert (row.n, row.missing, row.min, row.q1) == (0, 0, None, None)


def test_preview_and_structure(spark):
    frame = spark.createDataFrame([(i, None if i % 2 else f"t{i}") for i in range(20, 0, -1)], "n int, t string")
    assert [row.n for row in preview(frame, ["n"]).collect()] == [1, 2, 3, 4, 5, 6]
    assert preview(frame).count() == 6
    assert [tuple(row) for row in structure(frame, ["n"], 3).collect()] == [("n", "int", "1 2 3"), ("t", "string", "NA t2 NA")]
