"""Fetch logs and search pages: what a fetch loop with retries would have ended up with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

# Tries per request, ids per search page, and the status of a success.
MAX_ATTEMPTS = 5
PAGE_SIZE = 100
STATUS_OK = 200

#: Bits that hold a try's number.
_ATTEMPT_BITS = 14


def number_attempts(log: DataFrame, order_by: Sequence[str], key: str = "id", keep: int | None = MAX_ATTEMPTS) -> DataFrame:
    """Number the tries of each request in time order and keep those the retry limit allows, or all without a limit.

    Spark applies the limit in every task before the shuffle, so a request with very many rows moves
    no more than ``keep`` of them per task.
    """
    in_order = Window.partitionBy(key).orderBy(*order_by)
    numbered = log.withColumn("attempt", F.row_number().over(in_order))
    return numbered if keep is None else numbered.where(F.col("attempt") <= keep)


def first_success(
    log: DataFrame,
    values: Sequence[str] = ("body",),
    key: str = "id",
    attempt: str = "attempt",
    status: str = "status",
    max_attempts: int = MAX_ATTEMPTS,
) -> DataFrame:
    """Per request the values of its first successful try; NULL when none of the allowed tries succeeded.

    Rows without a key are no requests and are left out. A try that the log holds several times counts once: of rows that differ, the one with the smallest hash of its values is taken.
    The winning try of each request is found from key, attempt, status and that hash, aggregated in every task before the
    shuffle. Then the rows of successes meet the winners in a hash join: documents are moved once, and only those that
    are logged more than once are aggregated.
    """
    if not 0 < max_attempts < 1 << _ATTEMPT_BITS:
        raise ValueError(f"max_attempts is from 1 to {(1 << _ATTEMPT_BITS) - 1}")
    succeeded = F.coalesce((F.col(status) == STATUS_OK) & (F.col(attempt) <= max_attempts) & (F.col(attempt) >= 0), F.lit(False))
    log = log.where(F.col(key).isNotNull())
    if not values:
        return log.groupBy(key).agg(F.min(F.when(succeeded, F.col(attempt))).alias(attempt))
    # The try and the beginning of the hash as one number, which is aggregated without sorting.
    kept_bits = 62 - _ATTEMPT_BITS
    hashed = F.shiftrightunsigned(F.xxhash64(*values), 64 - kept_bits)
    rank = F.shiftleft(F.col(attempt).cast("long"), kept_bits).bitwiseOR(hashed)
    tried = log.select(key, F.when(succeeded, rank).alias("_rank")).groupBy(key, "_rank").agg((F.count(F.lit(1)) > 1).alias("_again"))
    best = F.min(F.shiftleft("_rank", 1).bitwiseOR(F.col("_again").cast("long"))).alias("_best")
    winners = tried.groupBy(key).agg(best).select(
        key, F.shiftright("_best", 1).alias("_rank"), F.col("_best").bitwiseAND(F.lit(1).cast("long")).alias("_again")
    )
    kinds = {field.name: field.dataType for field in log.schema}
    rows = log.where(succeeded).select(key, attempt, *values, rank.alias("_rank"))

    def found(again: int) -> DataFrame:
        return rows.join(winners.where(F.col("_again") == again).hint("shuffle_hash"), [key, "_rank"]).select(key, attempt, *values)

    missing = winners.where(F.col("_rank").isNull())
    missing = missing.select(key, *[F.lit(None).cast(kinds[name]).alias(name) for name in (attempt, *values)])
    return found(0).unionByName(found(1).dropDuplicates([key])).unionByName(missing)


def search_cutoff(
    pages: DataFrame,
    offset: str = "retstart",
    n_ids: str = "n_ids",
    step: int = PAGE_SIZE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Where a search ends: the first offset with an empty or failed page, or with none landed.

    ``by`` separates searches; without it the result is one row, ``cut`` NULL when there are no pages.
    Every page marks its own offset, the next one and the first as looked for; the lowest offset at
    which no ids were found is the cut. That takes two small aggregations and no window over the pages.
    """
    found = F.coalesce(F.col(n_ids) > 0, F.lit(False))
    at = F.col(offset).cast("long")
    marks = F.array(
        F.struct(at.alias("at"), found.alias("found")),
        F.struct((at + step).alias("at"), F.lit(False).alias("found")),
        F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("found")),
    )
    looked_for = pages.select(*by, F.inline(marks)).groupBy(*by, "at").agg(F.bool_or("found").alias("found"))
    return looked_for.where(~F.col("found")).groupBy(*by).agg(F.min("at").alias("cut"))


def pages_before_cutoff(
    pages: DataFrame,
    offset: str = "retstart",
    n_ids: str = "n_ids",
    step: int = PAGE_SIZE,
    by: Sequence[str] = (),
) -> DataFrame:
    """The pages of a search, or of each search, in front of its ``search_cutoff``."""
    cuts = search_cutoff(pages, offset, n_ids, step, by)
    if not by:
        return pages.where(F.col(offset) < cuts.scalar())
    return pages.join(cuts, list(by)).where(F.col(offset) < F.col("cut")).select(*pages.columns)
