"""Mix sources to target weights by pivotal dependent rounding.

A document is wanted ``target / size`` of its source times; the whole part is certain, the fraction is a
probability. Two fractions at a time meet: size-weighted mass moves from one to the other, in a random
direction, until one of them is 0 or 1. The words taken from a source thus never drift from the target
by more than the one fraction that is still open. Blocks of items are worked off in parallel, each leaves
at most one open fraction, and these meet again in the next layer of a reduction tree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from seqwatch.llm.common import carried, free_name, store, unit

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
#: Items of a block: a fan-in of the reduction tree.
BLOCK = 4096
SEED = 20_017
WORD = r"[^\x20\x09-\x0D]+"


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_copies: int = MAX_COPIES,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source.

    Sizes are words. Sources in order of their code points, null last, have the weights in turn. Together
    they get ``share`` of all words; none gets more than ``max_copies`` times its own, what is over goes to
    the others by weight. ``copies`` is a whole number up to ``max_copies``, ``taken`` is copies times size.
    A null text or one without words has size 0; it is taken once if its source is, so that it neither
    vanishes nor counts. Rows that agree in id, source, size and text are items with a multiplicity and
    may differ by one copy. An empty table gives an empty result. Other columns are ignored. The outcome depends on
    the rows and the seed alone, not on their partitions.
    """
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), _size(F.col(text)).alias("size"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("content"),
    )
    settled = round_items(narrow, weights, share, max_copies, seed)
    each = _repeat(settled, "times", "turn")
    copies = F.col("whole") + F.when(F.col("turn") <= F.col("more"), 1).otherwise(0)
    each = each.withColumn("copies", copies.cast("long"))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def apply_mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_copies: int = MAX_COPIES,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: int = SEED,
) -> DataFrame:
    """The documents, each as often as the mix takes it: 0 to ``max_copies`` times. Rows equal in every column share their copies."""
    key = F.xxhash64(*[F.col(name) for name in docs.columns])
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), _size(F.col(text)).alias("size"), key.alias("content")
    )
    settled = round_items(narrow, weights, share, max_copies, seed)
    names = [free_name(docs, name) for name in ("_mix_key", "_mix_copies", "_mix_turn")]
    wanted = settled.select(F.col("content").alias(names[0]), (F.col("whole") * F.col("times") + F.col("more")).alias(names[1]))
    wanted = store(wanted.where(F.col(names[1]) > 0), "mixing-wanted")
    once = docs.withColumn(names[0], key).dropDuplicates([names[0]])
    return _repeat(once.join(wanted, names[0]), names[1], names[2]).drop(*names)


def _size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _repeat(rows: DataFrame, times: str, turn: str) -> DataFrame:
    """Each row ``times`` times, numbered from 1, some thousands at a time."""
    starts = F.sequence(F.lit(1).cast("long"), F.col(times).cast("long"), F.lit(BLOCK).cast("long"))
    start = free_name(rows, "_start")
    rows = rows.withColumn(start, F.explode(starts))
    return rows.withColumn(turn, F.explode(F.sequence(F.col(start), F.least(F.col(times), F.col(start) + BLOCK - 1)))).drop(start)


def round_items(narrow: DataFrame, weights: tuple[int, ...], share: float, max_copies: int, seed: int) -> DataFrame:
    """Items (doc_id, source, size, content) with times (equal rows), source_size, target, whole (copies of each row) and more (rows with one more)."""
    items = narrow.groupBy("doc_id", "source", "size", "content").agg(F.count(F.lit(1)).alias("times"))
    items = store(items, "mixing-items")
    targets = source_targets(items, weights, share, max_copies).withColumnRenamed("source", "t_source")
    open_ = items.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(rate).cast("long"), F.lit(max_copies))
    fraction = F.when(whole >= max_copies, 0.0).otherwise(rate - whole)
    # Of equal rows as many as possible are rounded for certain; what is left is one fraction for them all.
    extra = fraction * F.col("times")
    certain = F.floor(extra + 1e-12).cast("long")
    p = F.when((F.col("size") == 0) | (extra - certain <= 1e-12), 0.0).otherwise(extra - certain)
    # A document without words weighs nothing: it stays once, if its source is taken from.
    whole = F.when(F.col("size") == 0, F.least(F.lit(1), F.ceil(rate))).otherwise(whole)
    certain = F.when(F.col("size") == 0, 0).otherwise(certain)
    open_ = open_.withColumns({"whole": whole.cast("long"), "certain": certain.cast("long"), "p": p})
    open_ = store(open_.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size", "content")), "mixing-open")

    open_ = open_.withColumn("name", carried(F.col("doc_id")))
    rounded = pivotal_rounding(open_.select("number", "key", "name", "size", "content", "p"), seed)
    up = rounded.select(*[F.col(c).alias(f"up_{c}") for c in ("number", "name", "size", "content")])
    keys = [F.col(c).eqNullSafe(F.col(f"up_{c}")) for c in ("number", "name", "size", "content")]
    more = F.col("certain") + F.when(F.col("up_number").isNotNull(), 1).otherwise(0)
    settled = open_.join(up, keys, "left").withColumn("more", more)
    return settled.select("doc_id", "source", "size", "content", "times", "source_size", "target", "whole", "more")


def source_targets(items: DataFrame, weights: tuple[int, ...], share: float, max_copies: int) -> DataFrame:
    """source, number, source_size, target, one row per source.

    Sources fill like vessels of the width of their weight and a height of ``max_copies`` times their
    size over it. In order of height, the level is what is left of the budget over the weights not yet
    full; the first vessel that is not below its level has it, and so have all after it. The windows run over sources, not documents.
    """
    sizes = items.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("number", F.row_number().over(by_name) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("number") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(max_copies)).withColumn("height", F.col("cap") / F.col("weight"))
    everything = Window.orderBy("height", "number")
    below = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(whole)
    full = F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    width = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    ranked = ranked.withColumn("level", (total * share - full) / width)
    # Where every vessel is full, the level is the last height.
    level = F.coalesce(F.min(F.when(F.col("level") <= F.col("height"), F.struct("height", "number", "level"))).over(whole)["level"], F.max("height").over(whole))
    ranked = ranked.withColumn("reached", level)
    target = F.least("cap", F.col("weight") * F.col("reached"))
    return store(ranked.select("source", "number", "source_size", target.alias("target")), "mixing-targets")


def pivotal_rounding(items: DataFrame, seed: int = SEED) -> DataFrame:
    """Those of the items (number, key, name, size, content, p) that are rounded up."""
    open_ = items.where("p > 0")
    # Layer by layer the blocks become fewer; a source's own number of items decides how many it needs.
    counted = store(open_.groupBy("number").agg(F.count(F.lit(1)).alias("n")), "mixing-counts")
    open_ = open_.join(counted, "number").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    open_ = open_.withColumn("block", F.pmod(F.col("key"), F.col("blocks"))).drop("n")
    up, layer = None, 0
    while True:
        open_ = store(open_.groupBy("number", "block").applyInPandas(_settle(seed + layer), open_.schema), "mixing-layer")
        done = open_.where("p = 1")
        up = done if up is None else up.unionByName(done)
        open_ = open_.where("p > 0 and p < 1")
        if open_.agg(F.max("blocks")).first()[0] in (None, 1):
            break
        layer += 1
        open_ = open_.withColumn("blocks", F.ceil(F.col("blocks") / BLOCK)).withColumn("block", F.pmod("block", "blocks"))
    # One item of each source may be left: it is rounded by its own probability.
    last = open_.where(unit(seed + 1, F.col("key")) < F.col("p"))
    return up.unionByName(last)


def _settle(seed: int):
    """Rounds a block until one fraction at most is open."""

    def settle(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["key", "name", "size", "content"], kind="stable").reset_index(drop=True)
        chance = _uniform(block["key"].to_numpy(), seed)
        p, size = block["p"].to_numpy().tolist(), block["size"].to_numpy().tolist()
        held = 0
        for other in range(1, len(p)):
            a, b = p[held], p[other]
            # Mass that one can take up and the other can give, in words.
            to_held = min((1 - a) * size[held], b * size[other])
            to_other = min(a * size[held], (1 - b) * size[other])
            moved = to_held if chance[other] * (to_held + to_other) < to_other else -to_other
            a, b = _snap(a + moved / size[held]), _snap(b - moved / size[other])
            p[held], p[other] = a, b
            if a in (0.0, 1.0):
                held = other
        block["p"] = p
        return block

    return settle


def _snap(p: float) -> float:
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def _uniform(keys, seed: int):
    """Splitmix of the keys, as numbers in [0, 1)."""
    import numpy as np

    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) * 2.0**-53
