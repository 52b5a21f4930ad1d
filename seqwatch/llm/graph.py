"""Connected components as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqwatch.llm.common import store


def components(edges: DataFrame, one: str = "a", other: str = "b") -> DataFrame:
    """node, root for every end of an edge; nodes that are connected, and no others, have the same root.

    In each round every node moves to the least of itself and its neighbours, under names dealt anew at
    random, and edges follow their ends; what is left are fewer nodes, by a constant factor on average, whatever
    the shape. Then the moves are followed back. Every table is stored, so joins start from
    plain exchanges that adaptive execution can split where a hub holds most of the edges.
    """
    current = store(
        edges.select(F.col(one).cast("long").alias("a"), F.col(other).cast("long").alias("b")).where("a <> b").distinct(),
        "edges",
    )
    moves = []
    while not current.isEmpty():
        # xxhash64 maps 8 bytes one to one, so the new names are as good as the old.
        seed = F.lit(len(moves) + 1)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        named = both.select("a", F.xxhash64("b", seed).alias("near"))
        move = named.groupBy("a").agg(F.min("near").alias("near"))
        move = store(move.select(F.col("a").alias("node"), F.least("near", F.xxhash64("a", seed)).alias("to")), "moves")
        moves.append(move)
        ends = current.join(move.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a")
        ends = ends.join(move.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b")
        next_ = ends.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        current = store(next_.distinct(), "edges")
    if not moves:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves.pop().select("node", F.col("to").alias("root"))
    while moves:
        later = roots.select(F.col("node").alias("to"), "root")
        roots = store(moves.pop().join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "roots")
    return roots
