"""Candidate lists of any length as units of bounded size.

A list of up to ``block`` rows is one unit. A longer one is dealt into blocks, and each pair of blocks, a
block with itself included, is a unit: any two rows of the list meet in exactly one unit, or, if they share a block,
in that block's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def to_units(rows: DataFrame, lists: DataFrame, key: str, row_id: str, block: int) -> DataFrame:
    """The rows joined to ``lists`` (key, list_size), with low, high (the unit's blocks) and side (the row's block)."""
    dealt = rows.join(lists, key).withColumn("blocks", F.ceil(F.col("list_size") / block).cast("int"))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64(row_id, F.lit(5)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"low": F.least("side", "partner"), "high": F.greatest("side", "partner")}).drop(
        "blocks", "partner", "list_size"
    )


def map_units(units: DataFrame, key: str, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on frames that hold whole units, many small ones or one large one at a time, numbered in ``unit``."""
    columns = [key, "low", "high"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            held.append(batch)
            whole = pd.concat(held, ignore_index=True) if len(held) > 1 else batch
            last = whole[columns].to_numpy()
            open_from = int(np.flatnonzero((last != last[-1]).any(axis=1))[-1]) + 1 if (last != last[-1]).any() else 0
            if open_from:
                yield from worked(whole.iloc[:open_from])
            held = [whole.iloc[open_from:]]
        if held:
            yield from worked(pd.concat(held, ignore_index=True))

    def worked(whole: pd.DataFrame) -> Iterator[pd.DataFrame]:
        keys = whole[columns].to_numpy()
        starts = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
        yield work(whole.reset_index(drop=True).assign(unit=np.cumsum(starts) - 1))

    return units.repartition(*columns).sortWithinPartitions(*columns).mapInPandas(run, schema)


def pairs_within(unit: np.ndarray, side: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows that meet in their unit, one distance between them at a time. Rows of a unit are adjacent."""
    first = np.arange(len(unit))
    crossed = low != high
    for distance in range(1, len(unit)):
        first = first[first + distance < len(unit)]
        first = first[unit[first] == unit[first + distance]]
        if not len(first):
            return
        second = first + distance
        met = ~crossed[first] | (side[first] != side[second])
        yield first[met], second[met]
