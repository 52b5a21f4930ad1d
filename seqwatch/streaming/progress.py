"""Running counts of searches whose pages land in any order.

A search ends at its first empty page in the order of offsets. The state of a search is the next offset, its totals so far, and the
pages that have landed ahead of it; a page counts in the moment all before it have landed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seqwatch.functions.sequences import SEROTYPE_PHRASES, Rules, matches_rule
from seqwatch.operators.fetches import PAGE_SIZE
from seqwatch.session import ship_package

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def page_counts(pages: DataFrame, rules: Rules = SEROTYPE_PHRASES, documents: str = "documents") -> DataFrame:
    """search, retstart, listed, errors, bodies and n_<label> of each page, from its ``documents`` (an array of id and body).

    A page that failed has NULL for documents and lists nothing.
    """
    found = F.col(documents)
    bodies = F.filter(found, lambda d: d["body"].isNotNull())

    def accepted(phrases: Sequence[str]) -> Column:
        return F.size(F.filter(bodies, lambda d: matches_rule(d["body"], phrases)))

    counts = {"listed": F.size(found), "bodies": F.size(bodies), **{f"n_{label}": accepted(phrases) for label, phrases in rules.items()}}
    whole = {name: F.when(found.isNotNull(), count).otherwise(0).cast("long").alias(name) for name, count in counts.items()}
    errors = (whole["listed"] - whole["bodies"]).alias("errors")
    return pages.select("search", F.col("retstart").cast("long").alias("retstart"), *whole.values(), errors)


def search_progress(pages: DataFrame, rules: Rules = SEROTYPE_PHRASES, step: int = PAGE_SIZE) -> DataFrame:
    """A stream of ``page_counts`` as a stream of progress: one row per page that counts, with the search's totals up to it.

    Columns: search, retstart, pages, listed, errors, bodies, n_<label>, closed. The row of the first empty page closes its search and
    carries the totals; whatever lands later, and a page that lands again, changes nothing. In append mode, with a checkpoint, each
    row is given once, over restarts as well. The session's state store has to be RocksDB's.
    """
    spark = pages.sparkSession
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        raise ValueError(f"set {PROVIDER} to the RocksDB provider: state is kept in maps")
    ship_package(spark)
    names = counted(rules)
    totals = ", ".join(f"{name} bigint" for name in names)
    processor = SearchProgress(names, step)
    return pages.select("search", "retstart", *names).groupBy("search").transformWithStateInPandas(
        processor, f"search string, retstart bigint, pages bigint, {totals}, closed boolean", "Append", "None"
    )


def counted(rules: Rules) -> list[str]:
    return ["listed", "errors", "bodies", *[f"n_{label}" for label in rules]]


def latest(progress: DataFrame, rules: Rules = SEROTYPE_PHRASES) -> DataFrame:
    """Of progress rows the furthest of each search: its pages and totals so far, and whether it is closed."""
    columns = ["pages", *counted(rules), "closed"]
    furthest = progress.groupBy("search").agg(F.max_by(F.struct(*columns), F.struct("closed", "pages")).alias("last"))
    return furthest.select("search", "last.*")


class SearchProgress(StatefulProcessor):
    def __init__(self, names: list[str], step: int):
        self.names, self.step = names, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        counts = ", ".join(f"{name} bigint" for name in self.names)
        self.ahead = handle.getMapState("ahead", "retstart bigint", counts)
        self.so_far = handle.getValueState("so_far", f"next bigint, pages bigint, closed boolean, {counts}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.so_far.get() or (0, 0, False, *[0] * len(self.names))
        following, pages, closed, totals = before[0], before[1], before[2], list(before[3:])
        # Each look at the state is a request to the JVM: the offsets that are held are asked for once, and pages that count at once never get there.
        held = set() if closed else {offset for (offset,) in self.ahead.keys()}
        out = []
        for batch in rows:
            if closed:
                continue
            new: dict[int, tuple] = {}
            for offset, *counts in zip(*(batch[name].tolist() for name in ("retstart", *self.names)), strict=True):
                if offset >= following and offset not in held:
                    new.setdefault(int(offset), tuple(map(int, counts)))
            while not closed and (following in new or following in held):
                if following in new:
                    counts = new.pop(following)
                else:
                    counts = self.ahead.getValue((following,))
                    self.ahead.removeKey((following,))
                    held.remove(following)
                closed = not counts[0]
                if not closed:
                    pages += 1
                    totals = [a + b for a, b in zip(totals, counts, strict=True)]
                out.append((key[0], following, pages, *totals, closed))
                following += self.step
            if not closed:
                for offset, counts in new.items():
                    if offset >= following:
                        self.ahead.updateValue((offset,), counts)
                        held.add(offset)
        if closed and held:
            # Nothing behind the end is looked at again.
            self.ahead.clear()
        if out:
            self.so_far.update((following, pages, closed, *totals))
            yield pd.DataFrame(out, columns=["search", "retstart", "pages", *self.names, "closed"])

    def close(self) -> None:
        pass
