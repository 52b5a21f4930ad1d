"""Exact top-k by inner product: norm buckets, with length or coordinate pruning, and verified products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from seqwatch.llm.common import store, unit

K = 20
SCALE = 64
#: Candidates of a block, and queries of a block: what one task compares.
CANDIDATES, QUERIES = 8192, 1024
#: Candidates of a bucket: those of a block next to each other by length.
BUCKET = 512
#: The longest share of all vectors, the next, and so on: what is compared in a round, with the scores of the rounds before to go by.
ROUNDS = (1 / 16, 1 / 16, 1 / 8, 1 / 4, 1 / 2)
#: Cosine from which on a bucket is pruned by coordinates: below, nearly everything could still match by them.
COORDINATE_FROM = 0.1
#: Share of the query's coordinates looked at, the largest first.
FOCUS = 0.5
LARGEST, LEAST = 2**63 - 1, -(2**63)
FOUND = "query_row bigint, query_id bigint, row bigint, vec_id bigint, known boolean, score bigint"


def top_products(
    vectors: DataFrame, queries: Column, k: int = K, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``queries`` selects, its ``k`` highest inner products.

    Every component x becomes floor(scale * x) first; products are of whole numbers and exact. A score out of the range of a
    long is held at its end. Candidates are all other rows; ties go to the smaller vec_id, a null id after all others. Vectors that are null or hold a
    null or non-finite component, or one that is not finite once scaled, take no part; neither do pairs of unequal length. Empty vectors have products of 0.
    Rows that repeat an id are rows of their own, and candidates of each other. Queries with a null id are none. An empty table gives an empty result. Other
    columns are ignored.

    Lengths are compared in rounds, the longest vectors first. What a query has found so far is its least useful score: if even its product of lengths with a
    round's longest vector is less, the query goes no further, and what no query goes to isn't moved. The others meet the round's candidates block by block. A
    block is sorted by length into buckets, and for each the least useful score becomes a local threshold, the cosine that is still
    of use. Over 1 the bucket is skipped; when low, candidates that are too short are left out; else those whose product over the query's largest
    coordinates, with the most that the others can add, is too small. The rest are multiplied out.
    """
    # A null id is the largest number until the end, where ``known`` tells it from one.
    rows = vectors.select(
        F.coalesce(F.col(vec_id).cast("long"), F.lit(LARGEST)).alias("vec_id"), F.col(vec_id).isNotNull().alias("known"), F.coalesce(queries, F.lit(False)).alias("query"),
        F.col(embedding).isNotNull().alias("given"), F.transform(embedding, lambda x: x.cast("double") * scale).alias("raw"),
    )
    usable = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("given") & usable).withColumn("vector", F.transform("raw", _floor)).drop("raw", "given")
    # Too long for a double is infinitely long, which no score is too high for.
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("vector"), "length": length})
    # Vectors of one length are dealt over the rounds, too.
    rows = store(rows.withColumn("rank", F.col("length") * (1 + unit(F.col("row")) * 2.0**-30)), "topk-rows")
    shares = [1 - sum(ROUNDS[: i + 1]) for i in range(len(ROUNDS) - 1)]
    limits = rows.groupBy("dim").agg(F.percentile_approx("rank", shares, F.lit(10_000)).alias("limits"))
    earlier = F.size(F.filter("limits", lambda limit: F.col("rank") < limit))
    rows = store(rows.join(limits, "dim").withColumn("round", earlier).drop("limits", "rank"), "topk-rounds")

    best = rows.sparkSession.createDataFrame([], FOUND)
    for number in range(len(ROUNDS)):
        best = _round(rows.where("query and known"), rows.where(F.col("round") == number), best, k)
    ranked = best.withColumn("rank", F.row_number().over(_in_order()))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.expr("if(known, vec_id, null)").alias("vec_id"), "score")


def _in_order() -> WindowSpec:
    # An unknown id is the largest number, but comes after it.
    return Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", F.desc("known"), "row")


def _round(asked: DataFrame, candidates: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query among those found before and a round's candidates."""
    sizes = candidates.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / CANDIDATES).alias("blocks"), F.max("length").alias("longest"))
    sizes = store(sizes, "topk-sizes")  # as many rows as lengths of lists
    useful = best.groupBy(F.col("query_row").alias("row")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).drop("n")
    live = asked.join(useful, "row", "left").join(sizes, "dim").withColumn("least", F.coalesce("least", F.lit(LEAST)))
    # Rounding is allowed for generously; a tie is of use, it may have a smaller id.
    live = live.where(F.col("least") <= F.greatest(F.lit(0.0), F.col("length") * F.col("longest") * (1 + 1e-9)))
    live = store(live.select("dim", "row", "vec_id", "vector", "least", "blocks"), "topk-live")
    parts = store(live.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("parts")), "topk-parts")

    # Every block meets every part of the queries that go on: a stated query set against all rows, in blocks.
    keys = ["dim", "block", "part"]
    left = candidates.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).join(parts, "dim")
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))).select(*keys, "row", "vec_id", "known", "vector")
    right = live.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    # Both sides come from one table; names of their own keep them apart.
    right = right.select(*[F.col(name).alias(f"q_{name}") for name in (*keys, "row", "vec_id", "vector", "least")])
    found = left.groupBy(*keys).cogroup(right.groupBy(*[f"q_{name}" for name in keys])).applyInPandas(_search(k), FOUND)
    ranked = best.unionByName(found).withColumn("rank", F.row_number().over(_in_order())).where(F.col("rank") <= k)
    return store(ranked.drop("rank"), "topk-best")


def _floor(x: Column) -> Column:
    # Numbers from 2^52 on are whole already, and too large for floor, which gives a long.
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _search(k: int):
    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({name: pd.Series(dtype="int64") for name in ("query_row", "query_id", "row", "vec_id", "known", "score")})
        if candidates.empty or queries.empty:
            return empty
        query, q = queries["q_row"].to_numpy(), np.stack(queries["q_vector"].to_numpy()).astype(float)
        x = np.stack(candidates["vector"].to_numpy()).astype(float)
        ids = candidates["vec_id"].to_numpy()
        score, at = best_products(q, query, x, ids, candidates["row"].to_numpy(), k, queries["q_least"].to_numpy())
        filled = at >= 0
        which, column = np.nonzero(filled)
        found = at[which, column]
        return pd.DataFrame(
            {
                "query_row": query[which],
                "query_id": queries["q_vec_id"].to_numpy()[which],
                "row": candidates["row"].to_numpy()[found],
                "vec_id": ids[found],
                "known": candidates["known"].to_numpy()[found],
                "score": score[which, column],
            }
        )

    return search


def best_products(q, query, x, ids, rows, k: int, least=None) -> tuple[np.ndarray, np.ndarray]:
    """For each query the scores and places of its ``k`` best candidates, place -1 where fewer reach its ``least`` score."""
    order = np.lexsort((rows, ids, -_norm(x)))  # longest first
    norms, q_norms = _norm(x)[order], _norm(q)
    least = np.full(len(q), LEAST, dtype=np.int64) if least is None else least
    score = np.full((len(q), k), LEAST, dtype=np.int64)
    at = np.full((len(q), k), -1, dtype=np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        unit_x, unit_q = np.nan_to_num(x[order] / norms[:, None]), np.nan_to_num(q / q_norms[:, None])
    focused = _focused(unit_q)
    for begin in range(0, len(x), BUCKET):
        bucket = order[begin : begin + BUCKET]
        # The least score of use; ties count, they may have a smaller id. Rounding is allowed for generously.
        useful = np.maximum(np.where(at[:, -1] >= 0, score[:, -1], LEAST), least)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(useful > LEAST, useful.astype(float), -np.inf) / (q_norms * norms[begin])
        local = np.where(np.isnan(local), -np.inf, local) - 1e-9
        live = np.flatnonzero(local <= 1)
        if not len(live):
            continue
        mask = _keep(local[live], unit_q[live], focused[live], unit_x[begin : begin + BUCKET], norms[begin : begin + BUCKET], norms[begin])
        mask &= query[live][:, None] != rows[bucket][None, :]
        if not mask.any():
            continue
        found = np.where(mask, verified(q[live], x[bucket], mask), LEAST)
        mask &= found >= least[live][:, None]
        all_scores = np.concatenate([score[live], np.where(mask, found, LEAST)], axis=1)
        all_at = np.concatenate([at[live], np.where(mask, bucket[None, :], -1)], axis=1)
        # What reaches the k-th best score, ties included, is put in order.
        limit = -np.partition(-1 - all_scores, k - 1, axis=1)[:, k - 1] - 1
        which, column = np.nonzero((all_scores >= limit[:, None]) & (all_at >= 0))
        scores, places = all_scores[which, column], all_at[which, column]
        best = np.lexsort((rows[places], ids[places], -1 - scores, which))
        which, scores, places = which[best], scores[best], places[best]
        rank = np.arange(len(which)) - np.searchsorted(which, which)
        top = rank < k
        score[live], at[live] = LEAST, -1
        score[live[which[top]], rank[top]], at[live[which[top]], rank[top]] = scores[top], places[top]
    return score, at


def _focused(unit_q: np.ndarray) -> np.ndarray:
    """Which coordinates of each query are looked at: its largest."""
    n = max(1, int(unit_q.shape[1] * FOCUS)) if unit_q.shape[1] else 0
    chosen = np.argsort(-np.abs(unit_q), axis=1, kind="stable")[:, :n]
    out = np.zeros(unit_q.shape, dtype=bool)
    np.put_along_axis(out, chosen, True, axis=1)
    return out


def _keep(need, unit_q, focused, unit_x, norms, longest) -> np.ndarray:
    """Which candidates of a bucket each query must look at: each query's own threshold says by which way this is told."""
    with np.errstate(divide="ignore", invalid="ignore"):
        # By length. Any direction is still of use to a query whose least useful score is not positive.
        mask = (norms[None, :] >= need[:, None] * longest) | (need[:, None] <= 0)
    by_coordinates = np.flatnonzero(need >= COORDINATE_FROM)
    if len(by_coordinates) and unit_x.shape[1] > 1:
        looked_at = focused[by_coordinates]
        seen = np.where(looked_at, unit_q[by_coordinates], 0.0)
        part = seen @ unit_x.T
        # The others' product is at most the product of the lengths that are left.
        q_rest = np.maximum(0.0, 1 - (seen * seen).sum(axis=1))
        x_rest = np.maximum(0.0, 1 - looked_at.astype(float) @ (unit_x * unit_x).T)
        most = (part + np.sqrt(q_rest[:, None] * x_rest) + 1e-9) * norms[None, :]
        mask[by_coordinates] &= most >= need[by_coordinates][:, None] * longest
    return mask


def verified(q: np.ndarray, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The exact products of the pairs in the mask; 0 elsewhere."""
    if mask.mean() > 0.5:
        return exact_products(q, x)
    out = np.zeros(mask.shape, dtype=np.int64)
    some = mask.any(axis=1)
    for i in np.flatnonzero(some):
        columns = np.flatnonzero(mask[i])
        out[i, columns] = exact_products(q[i : i + 1], x[columns])[0]
    return out


def _norm(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1, initial=0)
    scaled = x / np.where(most > 0, most, 1)[:, None]
    return np.sqrt((scaled * scaled).sum(axis=1)) * most


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, in floating point while that is exact, in Python's integers beyond."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    one, other = [[int(v) for v in row] for row in q], [[int(v) for v in row] for row in x]
    held = [[max(LEAST, min(LARGEST, sum(a * b for a, b in zip(r, s, strict=True)))) for s in other] for r in one]
    return np.array(held, dtype=np.int64).reshape(len(q), len(x))
