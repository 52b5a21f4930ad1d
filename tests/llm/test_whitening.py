import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqwatch.llm import whitening
from seqwatch.llm.queries import op11_whitening

SF_DIR = "/root/testdata/sf0.01"
VECTORS = "vec_id bigint, embedding array<double>, n int, component int, key int, x int, dim int, weight int"


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, *[1] * 6) for i, v in rows], VECTORS)


def check(out, rows, weights="counts", components=32):
    """Hold the rows against a fit of the whole list by Python's numbers and numpy."""
    usable = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    listed = [x for _, x in usable] if weights == "counts" else [list(x) for x in {tuple(x) for _, x in usable}]
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    y = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in listed])
    covariance = y.T @ y / n
    values = np.linalg.eigvalsh(covariance)[::-1]
    kept = min(components, int((values > values[0] * 1e-11).sum()))
    assert len(out) == len(usable) * kept
    got = sorted(out, key=lambda r: (str(r.vec_id), r.component))
    expected_deviation = sorted((str(i), sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in usable)
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == expected_deviation
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-4 and len({r.identity_error for r in got}) == 1
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(covariance), rel=1e-6)
    if weights == "counts" and len({i for i, _ in usable}) == len(usable):
        table = np.zeros((len(usable), kept))
        order = {i: at for at, (i, _) in enumerate(usable)}
        for r in got:
            table[order[r.vec_id], r.component - 1] = r.whitened
        assert np.abs(table.T @ table / n - np.eye(kept)).max() < 1e-8
        # Each column is a unit eigenvector's projection, up to its sign, over the root of its eigenvalue.
        for k in range(kept):
            direction = np.linalg.lstsq(y, table[:, k] * math.sqrt(values[k]), rcond=None)[0]
            assert np.linalg.norm(covariance @ direction - values[k] * direction) < 1e-6 * values[0]


def test_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    check(op11_whitening(spark, SF_DIR).collect(), rows)


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_copies_weigh(spark, weights):
    rng = np.random.default_rng(3)
    base = [(i, rng.standard_normal(5).tolist()) for i in range(60)]
    rows = base + [(100 + i, base[0][1]) for i in range(80)] + [(200 + i, base[i][1]) for i in range(9)]
    out = whitening.whiten(frame_of(spark, rows), weights=weights).collect()
    check(out, rows, weights)
    by_id = {(r.vec_id, r.component): (r.whitened, r.deviation) for r in out}
    assert all(by_id[0, k] == by_id[100 + i, k] for i in range(80) for k in range(1, 6))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(20)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[1][1]), (None, rows[1][1])]
    rows += [(50, None), (51, [nan, 0.0, 0.0]), (52, [0.0, inf, 0.0]), (53, [0.0, None, 1.0])]
    check(whitening.whiten(frame_of(spark, rows)).collect(), rows)


def test_lengths_are_lists_of_their_own(spark):
    rng = np.random.default_rng(5)
    three = [(i, rng.standard_normal(3).tolist()) for i in range(12)]
    five = [(100 + i, rng.standard_normal(5).tolist()) for i in range(15)]
    out = whitening.whiten(frame_of(spark, three + five + [(200, [])])).collect()
    check([r for r in out if r.vec_id < 100], three)
    check([r for r in out if r.vec_id >= 100], five)


def test_no_variance_and_empty(spark):
    assert whitening.whiten(frame_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(frame_of(spark, [(1, [1.0, 2.0])])).collect() == []
    out = whitening.whiten(frame_of(spark, []))
    assert out.collect() == [] and dict(out.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double",
    }
    # One entry varies: one component.
    out = whitening.whiten(frame_of(spark, [(i, [float(i), 7.0]) for i in range(10)])).collect()
    assert len(out) == 10 and {r.component for r in out} == {1}


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e11 * i, -3e10 * i * i]) for i in range(6)] + [(9, [1e300, -1e300])]
    out = {(r.vec_id, r.component): r for r in whitening.whiten(frame_of(spark, rows)).collect()}
    listed = [[max(-(2**52), min(2**52, math.floor(64 * c))) + 1_000_000 for c in v] for _, v in rows]
    n, sums = 7, [sum(c) for c in zip(*listed)]
    for (i, _), x in zip(rows, listed):
        exact = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        assert out[i, 1].deviation == (exact if exact < 2**63 else None)


def test_other_types(spark):
    frame = spark.createDataFrame([(i, [i % 3, i % 5, i]) for i in range(30)], "vec_id int, embedding array<int>")
    check(whitening.whiten(frame).collect(), [(i, [i % 3, i % 5, i]) for i in range(30)])
    assert frame.select(F.count("*")).first()[0] == 30
