import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqwatch.llm import sharding
from seqwatch.llm.queries import op3_sharding

SF_DIR = "/root/testdata/sf0.01"


def test_all_documents_in_near_equal_shards_with_gapless_slots(spark):
    rows = op3_sharding(spark, SF_DIR).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == sorted((s, i) for s, n in sizes.items() for i in range(n))
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


def test_odd_rows(make_docs, odd_rows):
    rows = sharding.shard_documents(make_docs(odd_rows), 3).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in odd_rows)
    assert sorted(Counter(r.shard for r in rows).values()) == [4, 5, 5]
    null = [r for r in rows if r.doc_id == 4]
    assert (null[0]["size"], null[0].text_crc32) == (16, 0)
    assert sharding.shard_documents(make_docs([])).collect() == []
    # Fewer rows than shards.
    assert sorted(r.shard for r in sharding.shard_documents(make_docs([(1, "a", "a")]), 40).collect()) == [0]


def test_reruns_agree(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    one, two = (sorted(map(repr, sharding.shard_documents(docs, 4).collect())) for _ in range(2))
    assert one == two


@pytest.mark.parametrize("rest, quota, n", [(20, 7, 5), (50, 25, 25), (9, 9, 4), (9, 0, 4), (1000, 30, 500)])
def test_draws_are_hypergeometric(spark, rest, quota, n):
    from math import comb

    state = F.struct(F.lit(rest).alias("rest"), F.lit(quota).alias("quota"), F.lit(n).alias("n"), ((F.col("id") + 0.5) / 20_000).alias("u"))
    drawn = spark.range(20_000).select(sharding.hypergeometric(state).alias("x")).groupBy("x").count().collect()
    for row in drawn:
        expected = comb(quota, row.x) * comb(rest - quota, n - row.x) / comb(rest, n)
        # The inputs are a grid, so each outcome has its exact share, but for one grid point on either side.
        assert abs(row["count"] / 20_000 - expected) <= 2.1 / 20_000


def test_matrix_has_the_margins_it_must(spark):
    parted = spark.range(10_000).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(16)))
    matrix = {r.part: r.quotas for r in sharding.communication_matrix(parted, 4, 10_000, 7).collect()}
    counts = {r.part: r["count"] for r in parted.groupBy("part").count().collect()}
    assert {p: sum(q) for p, q in matrix.items()} == counts
    assert np.array(list(matrix.values())).sum(axis=0).tolist() == [1429, 1429, 1429, 1429, 1428, 1428, 1428]


def test_places_are_uniform(spark):
    rows = spark.range(4000).select(F.col("id").alias("row"))
    seen = Counter()
    for seed in range(0, 60, 10):
        dealt = sharding.deal(sharding.store(rows, "test"), 5, seed)
        assert dealt.count() == 4000
        seen.update(r.slot // 200 for r in dealt.collect())
    assert set(seen.values()) == {6 * 1000}


def test_no_python_in_the_tasks(spark):
    plan = op3_sharding(spark, SF_DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
