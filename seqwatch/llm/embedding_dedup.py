"""Near-duplicate embeddings by random-hyperplane signatures, exact cosines and connected components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from seqwatch.llm.blocks import map_units, to_units
from seqwatch.llm.common import store
from seqwatch.llm.graph import components

LEAST_COSINE = 0.98
#: Share of the pairs at the least cosine that the tables find; closer pairs are found more often.
RECALL = 0.995
#: Vectors compared at once, at most, in each of two blocks.
BLOCK = 1024
SEED = 20_023


def near_duplicates(
    vectors: DataFrame, least: float = LEAST_COSINE, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding",
    label: str = "label", seed: int = SEED,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null, their lengths are equal, and their cosine in
    double precision is ``least`` or more. A vector that is null, empty, zero or holds a null or non-finite component links
    with nothing. ``n_links`` counts the other rows linked directly; equal vectors of a label link. ``component_id``
    is the smallest vec_id reachable (null only if no row of the component has one) and ``kept`` whether it is the row's
    own. Repeated ids are rows of their own. An empty table gives an empty result. Other columns are ignored.

    Equal vectors are one class first. A class's signature in a table says on which side of some random planes it lies;
    classes of equal signature meet in a list, long lists in blocks. The number of planes follows the logarithm of
    the number of classes, the number of tables the recall.
    """
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("vector")
    )
    rows = rows.withColumn("class", F.when(_comparable(F.col("vector")) & F.col("label").isNotNull(), F.xxhash64("label", "vector")))
    known = rows.where("class is not null")
    classes = store(
        known.groupBy("class", "label", "vector").agg(F.count(F.lit(1)).alias("times")).withColumn("dim", F.size("vector")), "vector-classes"
    )
    members = store(rows.select("vec_id", "class"), "vector-members")
    found = link_classes(classes, least, recall, seed)

    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.select("class", "root"), "class", "root")
    per_class = classes.select("class", "times").join(links, "class", "left").join(
        roots.withColumnRenamed("node", "class"), "class", "left"
    )
    per_class = store(
        per_class.select(
            "class", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "class").alias("root"),
            F.coalesce(F.col("root").isNotNull(), F.lit(False)).alias("joined"),
        ),
        "vector-links",
    )
    placed = store(members.join(per_class, "class", "left"), "vector-placed")
    least_ids = store(placed.where("class is not null").groupBy("joined", "root").agg(F.min("vec_id").alias("component_id")), "vector-components")
    out = placed.join(least_ids, ["joined", "root"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").cast("long").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _comparable(vector: Column) -> Column:
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(usable & F.exists(vector, lambda x: x != 0), F.lit(False))


def shape(n_classes: int, least: float, recall: float) -> tuple[int, int]:
    """Planes per table and tables for so many classes."""
    planes = min(60, max(8, math.ceil(math.log2(max(2, n_classes))) - 2))
    agree = (1 - math.acos(least) / math.pi) ** planes
    return planes, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def link_classes(classes: DataFrame, least: float, recall: float, seed: int) -> DataFrame:
    """class, links, root: for each class and unit it links in, the rows it links to there and the least class reached."""
    planes, tables = shape(classes.count(), least, recall)

    def sign(batches):
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                signs = signatures(np.stack(part["vector"].to_numpy()), planes, tables, seed)
                yield pd.DataFrame(
                    {
                        "class": np.repeat(part["class"].to_numpy(), tables),
                        "label": np.repeat(part["label"].to_numpy(), tables),
                        "dim": dim,
                        "table": np.tile(np.arange(tables, dtype=np.int32), len(part)),
                        "sign": signs.reshape(-1),
                    }
                ).astype({"dim": "int32"})

    kind = classes.schema["label"].dataType.simpleString()
    signed = classes.select("class", "label", "dim", "vector").mapInPandas(
        sign, f"class bigint, label {kind}, dim int, table int, sign bigint"
    )
    slots = store(signed.select("class", "table", F.xxhash64("label", "dim", "table", "sign").alias("list")), "vector-slots")
    lists = slots.groupBy("list").agg(F.count(F.lit(1)).alias("list_size")).where("list_size > 1")
    units = to_units(slots, store(lists, "vector-lists"), "list", "class", BLOCK)
    units = units.join(classes.select("class", "vector", "times"), "class")

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [_unit_links(part, least, planes, tables, seed) for _, part in frame.groupby("unit", sort=False)]
        return pd.concat(parts, ignore_index=True)

    return store(map_units(units, "list", work, "class bigint, links bigint, root bigint"), "vector-found")


def signatures(vectors: np.ndarray, planes: int, tables: int, seed: int) -> np.ndarray:
    """One row per vector, one number per table."""
    normals = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * planes))
    # A scale has no part in the signs, and keeps large components from overflowing.
    sides = (vectors / np.abs(vectors).max(axis=1, keepdims=True)) @ normals > 0
    return sides.reshape(len(vectors), tables, planes) @ (1 << np.arange(planes, dtype=np.int64))


def _unit_links(part: pd.DataFrame, least: float, planes: int, tables: int, seed: int) -> pd.DataFrame:
    ids, times, table = part["class"].to_numpy(), part["times"].to_numpy(), int(part["table"].iat[0])
    vectors = np.stack(part["vector"].to_numpy()).astype(np.float64)
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    scaled /= np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    side = part["side"].to_numpy()
    if part["low"].iat[0] == part["high"].iat[0]:
        one, other = np.nonzero(np.triu(scaled @ scaled.T >= least, 1))
    else:
        left, right = np.flatnonzero(side == part["low"].iat[0]), np.flatnonzero(side == part["high"].iat[0])
        one, other = np.nonzero(scaled[left] @ scaled[right].T >= least)
        one, other = left[one], right[other]
    if not len(one):
        return pd.DataFrame({"class": ids[:0], "links": times[:0], "root": ids[:0]})
    signs = signatures(vectors, planes, tables, seed)
    counted = (signs[one] == signs[other]).argmax(axis=1) == table  # a pair counts in the first table where it meets
    links = np.bincount(one[counted], times[other[counted]], len(ids)) + np.bincount(other[counted], times[one[counted]], len(ids))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = np.arange(len(ids))
    root = rank.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, one, before[other])
        np.minimum.at(root, other, root[one])
        if (root == before).all():
            break
    linked = np.zeros(len(ids), dtype=bool)
    linked[one] = linked[other] = True
    return pd.DataFrame({"class": ids[linked], "links": links[linked].astype(np.int64), "root": ids[order][root[linked]]})
