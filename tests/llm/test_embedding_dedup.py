import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqwatch.llm import embedding_dedup
from seqwatch.llm.queries import op4_embedding_dedup

SF_DIR = "/root/testdata/sf0.1"


def brute(rows, least=0.98):
    """(vec_id, label, vector) -> row number -> links and smallest id reachable."""

    def usable(label, vector):
        return label is not None and vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector)

    n, links = len(rows), {i: set() for i in range(len(rows))}
    by_label = {}
    for i, (_, label, vector) in enumerate(rows):
        if usable(label, vector):
            by_label.setdefault((label, len(vector)), []).append(i)
    for members in by_label.values():
        x = np.array([rows[i][2] for i in members], dtype=float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= least)):
            if a != b:
                links[members[a]].add(members[b])
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            best = min([root[i], *[root[j] for j in links[i]]])
            changed |= best != root[i]
            root[i] = best
    least_id = {}
    for i in range(n):
        ids = [v for v in (least_id.get(root[i]), rows[i][0]) if v is not None]
        least_id[root[i]] = min(ids, default=None)
    return links, [least_id[root[i]] for i in range(n)]


def test_whole_table_against_brute_force(spark, tmp_path):
    """The table, and every tenth vector of it five times more, moved a little or much."""
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "label", "embedding")
    rng = np.random.default_rng(2)
    rows = [tuple(r) for r in table.collect()]
    moved = [
        (100_000 + 10 * i + j, label, (np.array(vector) + rng.uniform(0, 0.04) * rng.standard_normal(len(vector))).tolist())
        for i, (_, label, vector) in enumerate(rows[::10])
        for j in range(5)
    ]
    spark.createDataFrame(rows + moved, "vec_id bigint, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = [tuple(r) for r in spark.read.parquet(str(tmp_path / "embeddings.parquet")).collect()]
    links, smallest = brute(rows)
    out = {r.vec_id: r for r in op4_embedding_dedup(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    found, there = sum(r.n_links for r in out.values()), sum(map(len, links.values()))
    assert 0.98 * there <= found <= there > 0
    assert all(out[r[0]].n_links <= len(links[i]) for i, r in enumerate(rows))
    same = sum(out[r[0]].component_id == smallest[i] for i, r in enumerate(rows))
    assert same >= 0.99 * len(rows)
    assert all(r.kept == (r.component_id == r.vec_id) for r in out.values())


@pytest.fixture(scope="module")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    base = rng.standard_normal(8)
    near = [(100 + i, 1, (base + 0.02 * rng.standard_normal(8)).tolist()) for i in range(40)]
    rows = [
        (1, 1, [1.0, 0.0]), (2, 1, [2.0, 0.0]), (2, 1, [2.0, 0.0]), (3, 2, [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, 1, None), (6, 1, []), (7, 1, [0.0, 0.0]),
        (8, 1, [nan, 1.0]), (9, 1, [inf, 1.0]), (10, 1, [None, 1.0]), (11, 1, [1e300, 1e290]), (12, 1, [1e-300, 0.0]), (None, 1, [1.0, 0.01]),
        (13, 1, [1.0, 0.0, 0.0]), (14, 1, [-1.0, 0.0]), *near,
    ]
    frame = spark.createDataFrame([(i, v, lab) for i, lab, v in rows], "vec_id bigint, embedding array<double>, label int")
    return frame.withColumns({n: F.lit("clash") for n in ("class", "table", "sign", "list", "links", "root", "times", "vector")}), rows


@pytest.mark.parametrize("block", [1024, 7])
def test_odd_vectors(odd_vectors, monkeypatch, block):
    """Also with lists of more vectors than a block holds."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    frame, rows = odd_vectors
    links, smallest = brute(rows)
    out = embedding_dedup.near_duplicates(frame, recall=1 - 1e-12).collect()
    wanted = sorted(repr((r[0], len(links[i]), smallest[i], r[0] == smallest[i])) for i, r in enumerate(rows))
    assert sorted(repr(tuple(r)) for r in out) == wanted


def test_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).collect() == []


def test_tables_grow_with_the_classes():
    assert embedding_dedup.shape(10, 0.98, 0.99) == (8, 6)
    planes, tables = embedding_dedup.shape(10**9, 0.98, 0.99)
    assert planes == 28 and 1 - (1 - (1 - math.acos(0.98) / math.pi) ** planes) ** tables >= 0.99
