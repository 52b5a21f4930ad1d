"""Source divergence audit: how far the words of each source are from those of the others of its language.

Texts that are met more than once in a language are tokenised once and counted with the number of their copies in each source;
what is met once is counted where it stands, without being moved. Two sources are compared over the terms
that one of them has; for the rest, which neither has, the sum has a closed form.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

from seqwatch.llm.common import store
from seqwatch.llm.jaccard import _marked, marks

#: Documents of a language that a term must be in to be kept.
LEAST_DOCUMENTS = 30
#: What is added to every count, and what a share of one is.
ADDED, UNIT = 5, 1_000_000_000
#: Terms listed per group.
LISTED = 50
#: Terms that a task holds before it hands them on.
HELD = 400_000
#: Parts that the pairs of a language's sources are dealt into.
DEALT = 16

#: Bytes that are no part of a term. Those of other scripts' letters all are.
_APART = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(0x20 if b in _APART else b for b in range(256)).lower()
_COUNTED = "lang string, source string, term string, occurrences bigint, documents bigint"


def tokens(text: bytes) -> list[bytes]:
    """The runs of letters A to Z and of anything beyond ASCII, A to Z in lower case."""
    return text.translate(_TABLE).split()


def audit(
    docs: DataFrame,
    least_documents: int = LEAST_DOCUMENTS,
    listed: int = LISTED,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language its distances to the others, and its telling terms.

    A term is kept in a language if ``least_documents`` of its documents have it. With V kept terms, count occurrences of one in a group and N of
    all of them, its share is ``1 + floor(10^9 (count + 5) / (N + 5 V))``. Part ``pair``: each other source with the sum of the absolute differences
    of all shares. Part ``term``: the ``listed`` terms whose share is the furthest above the language's. Ranks go by falling value,
    then item. All is exact. Null text, language and source are ''; a source whose documents have no term has its rows of
    pairs. Without kept terms distances are 0. Repeated rows count each. An empty table gives an empty result. Other columns are ignored.
    """
    narrow = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    kept, groups = kept_counts(narrow, least_documents)
    return _pairs(kept, groups).unionByName(_terms(kept, groups, listed))


def kept_counts(narrow: DataFrame, least_documents: int) -> tuple[DataFrame, DataFrame]:
    """Every group's kept terms with their shares, and every group with its shares' totals."""
    # Which texts have copies: their digests, without the texts.
    narrow = narrow.withColumn("key", F.unhex(F.sha2("text", 256)))
    multiplicities = store(narrow.groupBy("lang", "source", "key").agg(F.count(F.lit(1)).alias("copies")), "divergence-copies")
    several = multiplicities.groupBy("lang", "key").agg(F.sum("copies").alias("copies")).where("copies > 1")
    several = store(several.select("lang", "key", F.xxhash64("lang", "key").alias("mark")), "divergence-several")
    bits = marks(several, F.col("mark"))

    marked = narrow.withColumn("mark", F.xxhash64("lang", "key"))
    once = marked.select("lang", "source", "text", "mark").mapInArrow(_count_unmarked(bits), _COUNTED)

    again = marked.select("lang", "key", "text", "mark").mapInArrow(_only_marked(bits), "lang string, key binary, text string")
    again = again.groupBy("lang", "key").agg(F.first("text").alias("text")).mapInArrow(_tokenise, "lang string, key binary, found array<struct<term:string,times:bigint>>")
    # A mark may be shared with a text that has no copies: those were left to this side as well, so all multiplicities are joined.
    weighed = store(again, "divergence-again").join(multiplicities, ["lang", "key"])
    weighed = weighed.select("lang", "source", "copies", F.inline("found")).groupBy("lang", "source", "term").agg(
        F.sum(F.col("times") * F.col("copies")).alias("occurrences"), F.sum("copies").alias("documents")
    )
    # One exchange serves the groups' sums and the languages'.
    counted = once.unionByName(weighed).repartition("lang", "term").groupBy("lang", "term", "source")
    counted = counted.agg(F.sum("occurrences").alias("count"), F.sum("documents").alias("documents"))
    of_term = Window.partitionBy("lang", "term")
    counted = counted.withColumns({"in_documents": F.sum("documents").over(of_term), "lang_count": F.sum("count").over(of_term)})
    kept = store(counted.where(F.col("in_documents") >= least_documents).select("lang", "source", "term", "count", "lang_count"), "divergence-kept")

    every_lang = multiplicities.select("lang").distinct()
    terms = kept.groupBy("lang", "term").agg(F.first("lang_count").alias("lang_count"))
    terms = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("lang_count").alias("lang_total"))
    langs = every_lang.join(terms, "lang", "left").fillna(0, ["n_kept", "lang_total"])
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("n_terms"))
    groups = multiplicities.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["total", "n_terms"])
    groups = groups.join(langs, "lang").withColumn("none", F.when(F.col("n_kept") > 0, _share(F.lit(0), F.col("total"), F.col("n_kept"))).otherwise(0))
    groups = store(groups, "divergence-groups")

    shares = kept.join(groups.drop("n_terms"), ["lang", "source"]).select(
        "lang", "source", "term", "none",
        _share(F.col("count"), F.col("total"), F.col("n_kept")).alias("p"),
        _share(F.col("lang_count"), F.col("lang_total"), F.col("n_kept")).alias("q"),
    )
    return store(shares, "divergence-shares"), groups


def _share(count: Column, total: Column, n_kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 n_kept)), in whole numbers that a billion counts don't overflow."""
    above = (count + ADDED).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = (total + ADDED * n_kept).cast("decimal(20,0)")
    # The remainder is exact, so what is left divides without a fraction.
    return ((above - above % below) / below + 1).cast("long")


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    # A sum of |p - q| over all kept terms, where absent terms have the group's share for none: the terms that neither has,
    # plus for each group what its own terms change if the other had none, plus what changes for terms that both have.
    shares = kept.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    shares = shares.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "terms")).alias("shares"))
    sides = groups.select("lang", "source", "n_kept", "n_terms", "none").join(shares, ["lang", "source"], "left")
    sides = store(sides, "divergence-sides")

    # The contract wants every two sources of a language; they are dealt over parts, not met in one.
    one = sides.select("lang", *[F.col(c).alias(f"{c}_a") for c in ("source", "n_kept", "none", "shares")])
    one = one.withColumn("part", F.pmod(F.xxhash64("source_a"), F.lit(DEALT)).cast("int"))
    other = sides.select("lang", *[F.col(c).alias(f"{c}_b") for c in ("source", "none", "shares")])
    other = other.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    pairs = one.join(other, ["lang", "part"]).where("source_a < source_b")
    apart = F.abs(F.col("none_a") - F.col("none_b"))
    base = F.col("n_kept_a") * apart + _against("shares_a", F.col("none_b"), apart) + _against("shares_b", F.col("none_a"), apart)
    pairs = pairs.select("lang", "source_a", "source_b", base.alias("base"))

    a = kept.select("lang", "term", *[F.col(c).alias(f"{c}_a") for c in ("source", "p", "none")])
    b = kept.select("lang", "term", *[F.col(c).alias(f"{c}_b") for c in ("source", "p", "none")])
    p_a, p_b, none_a, none_b = (F.col(c) for c in ("p_a", "p_b", "none_a", "none_b"))
    change = F.abs(p_a - p_b) - F.abs(p_a - none_b) - F.abs(p_b - none_a) + F.abs(none_a - none_b)
    both = a.join(b, ["lang", "term"]).where("source_a < source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(change).alias("change"))

    found = pairs.join(both, ["lang", "source_a", "source_b"], "left")
    found = store(found.select("lang", "source_a", "source_b", (F.col("base") + F.coalesce("change", F.lit(0))).alias("value")), "divergence-pairs")
    directed = found.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value").unionByName(
        found.select("lang", F.col("source_b").alias("source"), F.col("source_a").alias("item"), "value")
    )
    return directed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(_ranked()).alias("rank"))


def _against(shares: str, none: Column, apart: Column) -> Column:
    """What a group's own terms change in the sum if the other group has none of them. Its shares are as many as it has different counts."""
    added = F.aggregate(
        F.col(shares), F.lit(0).cast("long"), lambda total, share: total + share["terms"] * (F.abs(share["p"] - none) - apart)
    )
    return F.coalesce(added, F.lit(0).cast("long"))


def _ranked() -> WindowSpec:
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def _terms(kept: DataFrame, groups: DataFrame, listed: int) -> DataFrame:
    above = kept.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    # Spark keeps the first ranks of each task before it exchanges the rest.
    ranked = above.withColumn("rank", F.row_number().over(_ranked())).where(F.col("rank") <= listed)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


# Work of the tasks


class _Counts:
    """Terms by language and source, handed on whenever many are held."""

    def __init__(self):
        self.found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def add(self, lang: str, source: str, words: list[bytes]) -> None:
        occurrences, documents = self.found.setdefault((lang, source), (Counter(), Counter()))
        occurrences.update(words)
        documents.update(set(words))

    def full(self) -> bool:
        return sum(len(documents) for _, documents in self.found.values()) > HELD

    def take(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurrences, documents) in self.found.items():
            if not documents:
                continue
            terms = pa.array(list(documents), pa.binary()).cast(pa.string())
            n = len(terms)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang]).take(pa.array(np.zeros(n, np.int8))), pa.array([source]).take(pa.array(np.zeros(n, np.int8))), terms,
                    pa.array(list(map(occurrences.__getitem__, documents)), pa.int64()), pa.array(list(documents.values()), pa.int64()),
                ],
                names=["lang", "source", "term", "occurrences", "documents"],
            )
        self.found = {}


def _count_unmarked(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            alone = pa.array(np.flatnonzero(~_marked(bits, batch.column("mark").to_numpy())))
            texts = batch.column("text").take(alone).cast(pa.binary())
            langs, sources = (batch.column(c).take(alone).to_pylist() for c in ("lang", "source"))
            for i, (lang, source) in enumerate(zip(langs, sources, strict=True)):
                counts.add(lang, source, tokens(texts[i].as_py()))
                if i % 256 == 0 and counts.full():
                    yield from counts.take()
        yield from counts.take()

    return run


def _only_marked(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(_marked(bits, batch.column("mark").to_numpy())))
            if kept.num_rows:
                yield kept.select(["lang", "key", "text"])

    return run


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found_type = pa.list_(pa.struct([("term", pa.string()), ("times", pa.int64())]))
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        found = [[{"term": t.decode(), "times": n} for t, n in Counter(tokens(text.as_py())).items()] for text in texts]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("key"), pa.array(found, found_type)], names=["lang", "key", "found"])
