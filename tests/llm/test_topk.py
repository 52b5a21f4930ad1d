import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqwatch.checks.compare import connect, oracle_rows, spark_rows
from seqwatch.llm import topk
from seqwatch.llm.oracle import ORACLE
from seqwatch.llm.queries import op8_topk

SF_DIR = "/root/testdata/sf0.01"
VECTORS = "vec_id bigint, embedding array<double>, rank int, score int, block int, dim int, `class` int"


def brute(rows, k, scale=64):
    usable = [
        (i, v, [math.floor(scale * x) for x in vec])
        for i, (v, vec) in enumerate(rows)
        if vec is not None and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in vec)
    ]
    out = []
    for i, v, q in usable:
        if v is None or v % 20:
            continue
        scores = [(sum(a * b for a, b in zip(q, x)), w) for j, w, x in usable if j != i and len(x) == len(q)]
        held = sorted((-max(topk.LEAST, min(topk.LARGEST, s)), w is None, w or 0, w) for s, w in scores)[:k]
        out += [(v, r + 1, w, -s) for r, (s, _, _, w) in enumerate(held)]
    return sorted(map(repr, out))


def test_against_sql(spark):
    with connect(SF_DIR) as duck:
        assert spark_rows(op8_topk(spark, SF_DIR)) == oracle_rows(duck, ORACLE["op8_topk"])


@pytest.mark.parametrize("sizes", [(8192, 1024, 512), (16, 4, 5)])
def test_odd_vectors(spark, monkeypatch, sizes):
    for name, value in zip(("CANDIDATES", "QUERIES", "BUCKET"), sizes):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    nan, inf = float("nan"), float("inf")
    rows = [(i, (rng.standard_normal(6) * rng.choice([0.1, 1, 20])).round(2).tolist()) for i in range(120)]
    rows += [(40, rows[40][1]), (40, rows[40][1]), (200, [0.0] * 6), (220, rows[1][1]), (None, rows[2][1]), (240, None), (260, []), (261, []), (280, [nan] * 6)]
    rows += [(281, [inf] + [0.0] * 5), (300, [None] * 6), (320, [1e15, -1e14, 0.3, 0, 0, 0]), (340, [1e300] + [0.0] * 5), (341, [-1e300] + [0.0] * 5), (360, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None, 1, 1, 1, 1, 1) for i, v in rows], VECTORS)
    out = topk.top_products(frame, F.col("vec_id") % 20 == 0, 7).collect()
    assert sorted(repr(tuple(r)) for r in out) == brute(rows, 7)


def test_empty_table(spark):
    frame = spark.createDataFrame([], VECTORS)
    assert topk.top_products(frame, F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("spread", [0.0, 0.5, 3.0])
def test_pruning_loses_nothing(spread):
    """On lengths that vary little or much, and on directions that crowd."""
    rng = np.random.default_rng(5)
    for crowd in (0.0, 3.0):
        x = np.floor((rng.standard_normal((3000, 8)) + crowd * rng.standard_normal(8)) * 30 * np.exp(spread * rng.standard_normal((3000, 1))))
        ids = np.arange(3000)
        score, at = topk.best_products(x[:50], ids[:50], x, ids, ids, 10)
        products = x[:50] @ x.T
        products[np.arange(50), np.arange(50)] = -np.inf
        for i in range(50):
            order = np.lexsort((ids, -products[i]))[:10]
            assert at[i].tolist() == order.tolist() and score[i].tolist() == products[i, order].tolist()


def test_queries_away_from_a_cone_keep_their_best():
    """Nearly all vectors point one way, so a median query prunes by coordinates; a few queries point the other way."""
    rng = np.random.default_rng(7)
    x = np.array([1.0, 0, 0, 0, 0, 0]) + 0.1 * rng.standard_normal((4000, 6))
    x = np.floor(x / np.linalg.norm(x, axis=1)[:, None] * 1000)
    x[:5] *= -1
    ids = np.arange(4000)
    score, at = topk.best_products(x[:40], ids[:40], x, ids, ids, 20)
    products = x[:40] @ x.T
    products[np.arange(40), np.arange(40)] = -np.inf
    assert (np.sort(products[:5], axis=1)[:, -20] < 0).all()
    for i in range(40):
        order = np.lexsort((ids, -products[i]))[:20]
        assert at[i].tolist() == order.tolist() and score[i].tolist() == products[i, order].tolist()


def test_buckets_are_skipped(monkeypatch):
    """Where lengths differ, most products are never taken."""
    taken = []
    exact = topk.exact_products
    monkeypatch.setattr(topk, "exact_products", lambda q, x: taken.append(len(q) * len(x)) or exact(q, x))
    rng = np.random.default_rng(6)
    x = np.floor(rng.standard_normal((20_000, 8)) * 100 * np.exp(1.5 * rng.standard_normal((20_000, 1))))
    topk.best_products(x[:20], np.arange(20), x, np.arange(20_000), np.arange(20_000), 10)
    assert sum(taken) < 0.3 * 20 * 20_000


def test_random_directions_are_pruned_by_coordinates(monkeypatch):
    """Of vectors of one length that point anywhere most products are never taken once scores have been found."""
    taken = []
    exact = topk.exact_products
    monkeypatch.setattr(topk, "exact_products", lambda q, x: taken.append(len(q) * len(x)) or exact(q, x))
    rng = np.random.default_rng(8)
    x = rng.standard_normal((20_000, 64))
    x = np.floor(64 * x / np.linalg.norm(x, axis=1)[:, None])
    ids = np.arange(len(x))
    score, at = topk.best_products(x[:40], ids[:40], x, ids, ids, 20)
    assert sum(taken) < 0.3 * 40 * 20_000
    products = x[:40] @ x.T
    products[ids[:40], ids[:40]] = -np.inf
    assert (score == -np.sort(-products, axis=1)[:, :20]).all()


def test_scores_of_earlier_rounds_are_gone_by():
    """What can't reach the least useful score isn't given; what equals it is."""
    x = np.array([[5.0, 0], [4, 0], [3, 0], [2, 0], [-9, 0]])
    ids = np.arange(5)
    score, at = topk.best_products(np.array([[1.0, 0]]), np.array([99]), x, ids, ids, 4, np.array([3]))
    assert score[0].tolist()[:3] == [5, 4, 3] and at[0].tolist() == [0, 1, 2, -1]


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_rounds_against_brute_force(spark, spread):
    """Lengths that are all one, and lengths that vary so much that queries leave the rounds early."""
    rng = np.random.default_rng(9)
    rows = [(i, (rng.standard_normal(8) * np.exp(spread * rng.standard_normal())).round(3).tolist()) for i in range(400)]
    frame = spark.createDataFrame([(i, v, 1, 1, 1, 1, 1) for i, v in rows], VECTORS)
    out = topk.top_products(frame, F.col("vec_id") % 20 == 0, 5).collect()
    assert sorted(repr(tuple(r)) for r in out) == brute(rows, 5)
