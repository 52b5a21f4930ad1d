"""Uniform shuffle of documents into shards of exact sizes by a communication matrix.

The counts that each partition sends to each shard are drawn first: a matrix whose rows sum to the
partitions' sizes and whose columns sum to the shards' sizes, distributed as in a uniform random
permutation of all rows (multivariate hypergeometric). Then every partition permutes its own rows and
deals them out by its row of the matrix, and every shard permutes what it received.

The matrix comes from a binary tree over the partitions: a node splits its shard sizes between its
two halves, shard by shard, with one hypergeometric draw each. Nodes of a level are independent rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqwatch.llm.common import let, store, unit

#: What a document needs besides its text, in bytes.
OVERHEAD = 16
SHARDS = 40
SEED = 20_011


def shard_documents(
    docs: DataFrame, n_shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", seed: int = SEED
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: shard sizes differ by one row at most. Slots count from 0 without gaps in
    each shard. A null text counts as empty (size 16, checksum 0). Null or repeated ids and equal
    texts are rows like any other; every input row gets its own slot. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    content = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(content) + OVERHEAD).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = store(narrow, "sharding-rows")
    assigned = deal(rows, n_shards, seed)
    return assigned.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def deal(rows: DataFrame, n_shards: int, seed: int = SEED) -> DataFrame:
    """The rows with ``shard`` and ``slot``. They must hold ``row``, a unique and settled number.

    Rows are spread over as many partitions as the square root of their number, so that neither the
    partitions nor the matrix become large: both grow with the square root only.
    """
    n_rows = rows.count()
    levels = max(0, round(math.log2(max(1, n_rows)) / 2))
    n_parts = 2**levels
    parted = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n_parts)))
    matrix = communication_matrix(parted, levels, n_rows, n_shards, seed)

    # The row of the matrix as running sums: the k-th row of a permuted partition goes to the first shard that reaches k.
    sent = matrix.select(
        "part",
        F.transform(
            F.sequence(F.lit(1), F.lit(n_shards)), lambda i: _total(F.slice("quotas", F.lit(1), i))
        ).alias("reach"),
    )
    order = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), "row"), "row")
    dealt = parted.withColumn("k", F.row_number().over(order)).join(sent, "part")
    n_blocks = max(1, n_parts // n_shards)
    dealt = dealt.withColumn("shard", F.size(F.filter("reach", lambda c: c < F.col("k")))).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(seed + 2), "row"), F.lit(n_blocks))
    )
    dealt = store(dealt.drop("part", "k", "reach"), "sharding-dealt")

    # A shard is permuted by random blocks and a random order within each; a block's rows start where those before it end.
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "block").orderBy(F.xxhash64(F.lit(seed + 3), "row"), "row")
    slotted = dealt.withColumn("slot", F.row_number().over(within) - 1).join(starts, ["shard", "block"])
    return slotted.withColumn("slot", F.col("slot") + F.col("start")).drop("block", "start", "row")


def communication_matrix(parted: DataFrame, levels: int, n_rows: int, n_shards: int, seed: int = SEED) -> DataFrame:
    """part, quotas: how many rows each of the ``2**levels`` partitions sends to each shard."""
    spark = parted.sparkSession
    counted = parted.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(2**levels).select(F.col("id").alias("part")).join(counted, "part", "left")
    every = every.select(F.struct("part", F.coalesce("n", F.lit(0)).alias("n")).alias("entry"))
    share, more = divmod(n_rows, n_shards)
    nodes = every.agg(F.array_sort(F.collect_list("entry"))["n"].alias("counts")).select(
        F.lit(0).cast("long").alias("part"),
        "counts",
        F.transform(
            F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.lit(share) + F.when(s < more, 1).otherwise(0)
        ).cast("array<bigint>").alias("quotas"),
    )
    for level in range(levels):
        half = 2 ** (levels - level - 1)
        if level % 5 == 4:  # what was one row is many by now
            nodes = nodes.repartition("part")
        left = F.slice("counts", 1, half)
        nodes = nodes.withColumn("drawn", hypergeometric_split(F.col("quotas"), _total(left), F.col("part"), seed + 7 * level))
        sides = F.array(
            F.struct((F.col("part") * 2).alias("part"), left.alias("counts"), F.col("drawn").alias("quotas")),
            F.struct(
                (F.col("part") * 2 + 1).alias("part"),
                F.slice("counts", half + 1, half).alias("counts"),
                F.zip_with("quotas", "drawn", lambda all_, drawn: all_ - drawn).alias("quotas"),
            ),
        )
        nodes = nodes.select(F.inline(sides))
    return nodes.select("part", "quotas")


def hypergeometric_split(quotas: Column, n_drawn: Column, key: Column, seed: int) -> Column:
    """How many of ``n_drawn`` rows, drawn without replacement, belong to each shard of sizes ``quotas``."""

    def one(drawn: Column, at: Column) -> Column:
        state = F.struct(
            _total(F.slice(quotas, at, F.size(quotas))).alias("rest"),
            F.element_at(quotas, at).alias("quota"),
            (n_drawn - _total(drawn)).alias("n"),
            unit(seed, key, at).alias("u"),
        )
        return F.concat(drawn, F.array(let(state, hypergeometric)))

    return F.aggregate(F.sequence(F.lit(1), F.size(quotas)), F.array().cast("array<bigint>"), one)


def hypergeometric(state: Column) -> Column:
    """An exact draw by inversion from ``rest`` items, ``quota`` of them marked, ``n`` taken, at the uniform ``u``.

    Outcomes are gone through from the mode upwards, then from the mode downwards. Those more than 12
    standard deviations (and 12) away from the mode have together less weight than the last bit of ``u``.
    """
    rest, quota, n = (state[name].cast("double") for name in ("rest", "quota", "n"))
    spread = F.sqrt(
        F.greatest(F.lit(0.0), n * (quota / rest) * (1 - quota / rest) * (rest - n) / F.greatest(rest - 1, F.lit(1.0)))
    )
    least, most = F.greatest(F.lit(0.0), n + quota - rest), F.least(quota, n)
    mode = F.least(most, F.greatest(least, F.floor((n + 1) * (quota + 1) / (rest + 2)).cast("double")))
    known = F.struct(
        rest.alias("rest"), quota.alias("quota"), n.alias("n"), state["u"].alias("u"), mode.cast("long").alias("mode"),
        F.greatest(least, mode - F.ceil(12 * spread) - 12).cast("long").alias("low"),
        F.least(most, mode + F.ceil(12 * spread) + 12).cast("long").alias("high"),
    )

    def draw(x: Column) -> Column:
        def up(k: Column) -> Column:  # weight of k + 1 over that of k
            return (x["quota"] - k) * (x["n"] - k) / ((k + 1) * (x["rest"] - x["quota"] - x["n"] + k + 1))

        def down(k: Column) -> Column:  # weight of k - 1 over that of k
            return k * (x["rest"] - x["quota"] - x["n"] + k) / ((x["quota"] - k + 1) * (x["n"] - k + 1))

        above = F.when(x["high"] > x["mode"], F.sequence(x["mode"], x["high"] - 1)).otherwise(F.array().cast("array<bigint>"))
        below = F.when(x["low"] < x["mode"], F.sequence(x["mode"], x["low"] + 1, F.lit(-1))).otherwise(
            F.array().cast("array<bigint>")
        )

        def weigh(ratio):
            def step(acc: Column, k: Column) -> Column:
                weight = acc["weight"] * ratio(k.cast("double"))
                return F.struct(weight.alias("weight"), (acc["sum"] + weight).alias("sum"))

            return step

        start = F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"))
        total = F.lit(1.0) + F.aggregate(above, start, weigh(up))["sum"] + F.aggregate(below, start, weigh(down))["sum"]

        def seek(ratio, move: int):
            """Counts on until the running sum has reached the goal."""

            def step(acc: Column, k: Column) -> Column:
                weight, open_ = acc["weight"] * ratio(k.cast("double")), acc["sum"] < acc["goal"]
                return F.struct(
                    weight.alias("weight"),
                    (acc["sum"] + F.when(open_, weight).otherwise(0.0)).alias("sum"),
                    F.when(open_, k + move).otherwise(acc["at"]).alias("at"),
                    acc["goal"].alias("goal"),
                )

            return step

        def first(goal: Column, start_sum: Column) -> Column:
            return F.struct(F.lit(1.0).alias("weight"), start_sum.alias("sum"), x["mode"].alias("at"), goal.alias("goal"))

        def search(goal: Column) -> Column:
            def on(above_done: Column) -> Column:
                downwards = F.aggregate(below, first(goal, above_done["sum"]), seek(down, -1))["at"]
                return F.when(above_done["sum"] < goal, downwards).otherwise(above_done["at"])

            return let(F.aggregate(above, first(goal, F.lit(1.0)), seek(up, 1)), on)

        return let(x["u"] * total, search)

    return F.when((rest <= 0) | (quota <= 0) | (n <= 0), F.lit(0).cast("long")).otherwise(let(known, draw))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
