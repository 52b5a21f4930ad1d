"""N-gram Jaccard join: documents whose sets of word shingles are alike, by grouped prefixes.

With all shingles in one order, two sets of a Jaccard similarity of t or more share one of their first
``n - ceil(t n) + 1``, their prefixes. The order goes by how often a shingle is met in the corpus, as
counted in a table of fixed size: shingles that share a counter are taken for equally frequent, which costs time but no result.

Documents with equal sets are one class, classes with equal prefixes and sizes one group. Groups that
share a prefix shingle are listed, and pairs from a list pass by size, place and a parity bitmap before they are
expanded to their classes and verified by their whole sets. Components are what is asked for, so each list is first
compared with one of its groups only; then only pairs whose ends are still apart are looked at, all of them.

Pairs that share one prefix shingle tend to share many. Each entry of a list names the entry before it in its own prefix, so
rows that have come from the same list are seen to have met there: a list of such rows only is left out, and of
others such pairs are. The first of a run of shared lists remains, so every pair is looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from seqwatch.llm.blocks import map_units, pairs_within, to_units
from seqwatch.llm.common import carried, free_name, hand_back, in_slices, store
from seqwatch.llm.graph import components

WORDS = 3
#: Least similarity, as a fraction.
LEAST = (90, 100)
#: Counters of shingles: two to this power.
COUNTERS = 21
#: Rows of a list that are compared at once.
BLOCK = 512
#: Slots of a set's bitmap for each shingle that an alike set may have apart. Results do not depend on them.
SLOTS = 4
#: Bits that mark the shingles that are shared, or the documents whose sets are needed again: two to this power. With more
#: of them than bits the marks tell less, and more is moved or read; results do not depend on them.
MARKS = 25
#: Shingles of the sets that a unit of pairs is verified with; a unit with more is dealt further.
UNIT_SHINGLES = 1 << 19
#: Parts that are added up at once.
FAN_IN = 256

_COUNT_KINDS = (np.int8, np.int16, np.int32, np.int64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def similar_documents(
    docs: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A text's words are its runs of bytes other than blanks (0x20, 0x09 to 0x0D), with A to Z in lower case. Its set holds
    its distinct runs of ``words`` words; a text of fewer words has one, of all its words; one without words, or null, has none and links with
    nothing. Two documents link if ``least[1]`` times the intersection is ``least[0]`` times the union or more.
    ``component_id`` is the smallest doc_id reachable by links, the document's own included (null only where no id is). Repeated
    and null ids are rows of their own. An empty table gives an empty result. Other columns are ignored.

    Sets hold 64-bit hashes of the shingles.
    """
    placed, least_ids = _place(docs, words, least, doc_id, text)
    return placed.join(least_ids, ["joined", "root"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")
    )


def link_documents(
    docs: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The whole join, as two tables: doc_id, n_shingles, class_id, n_links for every document, and a, b for every two classes that link.

    A class has the documents of equal sets, which all link with each other; two documents of different classes link if and only
    if their classes do, and each such pair has one row, a < b. ``n_links`` counts the other documents that link. Documents without words have no class
    and no links. Else as ``similar_documents``.
    """
    narrow, signed = _signed(docs, words, least, doc_id, text)
    links = link_classes(narrow, signed, words, least, every=True)
    sizes = store(signed.where("n > 0").groupBy("class").agg(F.count(F.lit(1)).alias("copies")), "jaccard-sizes")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes.select(F.col("class").alias("b"), "copies"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("copies").alias("others"))
    counted = sizes.join(others, "class", "left").select("class", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    documents = signed.join(store(counted, "jaccard-counted"), "class", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("class").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return documents, links


def _signed(docs: DataFrame, words: int, least: tuple[int, int], doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The documents' ids and texts, and their sets' sizes, classes, groups and prefixes."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = count_shingles(narrow, words)
    signed = narrow.select(carried(F.col("doc_id")).alias("doc_id"), F.xxhash64("text").alias("content"), "text").mapInPandas(
        in_slices(_sign(words, least, counts)), "doc_id string, content bigint, n int, class bigint, gr bigint, prefix array<bigint>, bitmap binary"
    )
    return narrow, store(signed.withColumn("doc_id", F.col("doc_id").cast("long")), "jaccard-signed")


def _place(docs: DataFrame, words: int, least: tuple[int, int], doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Every document with its component (joined, root), and the smallest id of each."""
    narrow, signed = _signed(docs, words, least, doc_id, text)
    rooted = components(link_classes(narrow, signed, words, least))
    rooted = store(rooted.select(F.col("node").alias("class"), "root"), "jaccard-rooted")
    placed = signed.select("doc_id", "content", "n", "class").join(rooted, "class", "left").select(
        "doc_id", "content", "n", F.when(F.col("n") > 0, F.coalesce("root", "class")).alias("root"), F.col("root").isNotNull().alias("joined")
    )
    placed = store(placed, "jaccard-placed")
    least_ids = placed.where("n > 0").groupBy("joined", "root").agg(F.min("doc_id").alias("least"))
    return placed, store(least_ids, "jaccard-components")


def keep_one_each(docs: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of which one is kept of each component, with all their columns.

    The row of the smallest doc_id stays, of several such the one of the smallest text hash, of equal rows one.
    Documents without words link with nothing, so all of them stay. In components without any id the smallest text hash decides.
    """
    has_words = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    name = free_name(docs, "_kept_key")
    placed, _ = _place(docs, words, least, doc_id, text)
    best = placed.where("n > 0").groupBy("joined", "root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "content")).alias("best"))
    row_key = F.xxhash64(F.coalesce(F.col("best.doc_id").cast("string"), F.lit("")), F.col("best.doc_id").isNull(), F.col("best.content"))
    kept = store(best.select(row_key.alias(name)).distinct(), "jaccard-kept")
    content_key = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(doc_id).isNull(), F.xxhash64(F.col(text)))
    worded = docs.where(has_words).withColumn(name, content_key).dropDuplicates([name])
    return worded.join(kept, name, "left_semi").drop(name).unionByName(docs.where(~has_words))


# Sets


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words, by their bytes."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def shingle_hashes(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the runs of ``words`` words in order, of the whole where it is shorter."""
    n = min(words, len(hashes))
    if not n:
        return hashes
    mixed = _mixed(hashes[: len(hashes) - n + 1] + np.uint64(n))
    for i in range(1, n):
        mixed = _mixed(mixed * np.uint64(3) + hashes[i : len(hashes) - n + 1 + i] * _MIX)
    return mixed


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), words)) if text else np.empty(0, np.uint64)


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNTERS)).astype(np.int64)


def count_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """How many shingles of the corpus fall on each counter. The table has the same size for any corpus."""
    slice_bits = 12

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << COUNTERS, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                if text:
                    np.add.at(total, _counter(shingle_hashes(word_hashes(text), words)), 1)
        parts = total.reshape(-1, 1 << slice_bits)
        used = np.flatnonzero(parts.any(axis=1))
        # Few bytes as long as the numbers are small; the length tells which.
        small = parts.astype(next(kind for kind in _COUNT_KINDS if total.max() <= np.iinfo(kind).max))
        yield pd.DataFrame({"part": used, "counts": [small[i].tobytes() for i in used]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << slice_bits, dtype=np.int64)
        for counts in part["counts"]:
            total += np.frombuffer(counts, dtype=f"i{len(counts) >> slice_bits}")
        return pd.DataFrame({"part": part["part"].iloc[:1], "counts": [total.tobytes()], "task": part["task"].iloc[:1]})

    schema = "part int, counts binary"
    summed = docs.select("text").mapInPandas(in_slices(count), schema)
    # No sum has more parts than the fan-in: tasks are numbered, and what is left is added up in rounds.
    tasks = docs.rdd.getNumPartitions()
    summed = summed.withColumn("task", F.spark_partition_id())
    while tasks > FAN_IN:
        summed = summed.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("part", "task").applyInPandas(add, f"{schema}, task int")
        tasks = -(-tasks // FAN_IN)
    summed = summed.groupBy("part").applyInPandas(add, f"{schema}, task int")
    total = np.zeros((1 << COUNTERS - slice_bits, 1 << slice_bits), dtype=np.int64)
    for row in summed.collect():  # 2^21 numbers, whatever the corpus
        total[row.part] = np.frombuffer(row.counts, dtype=np.int64)
    return total.reshape(-1)


def prefix_length(n: int, least: tuple[int, int]) -> int:
    return n - -(-least[0] * n // least[1]) + 1


def parity_bitmap(shingles: np.ndarray, least: tuple[int, int] = LEAST) -> bytes:
    """A bit per slot, 256 or more (a power of two): whether an odd number of the set's members falls there.

    Sets that differ in d shingles have bitmaps that differ in d bits at most. There are ``SLOTS`` times as many slots as shingles that
    alike sets of this size may have apart, or up to twice as many again: with fewer, sets that are not quite alike would pass for it.
    """
    apart = int(most_differences(np.array([len(shingles)]), np.array([len(shingles)]), least)[0])
    bits = max(256, 1 << (SLOTS * apart - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sign(words: int, least: tuple[int, int], counts: np.ndarray):
    """Size, class, group and prefix of each document's set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                shingles = shingle_set(text, words)
                n = len(shingles)
                if not n:
                    rows.append((0, None, None, None, None))
                    continue
                by_count = np.lexsort((shingles, counts[_counter(shingles)]))
                prefix = shingles[by_count[: prefix_length(n, least)]]
                rows.append((n, _digest(shingles), _digest(prefix, n), prefix.view(np.int64), parity_bitmap(shingles, least)))
            n, classes, groups, prefixes, bitmaps = zip(*rows, strict=True) if rows else ((),) * 5
            # Long numbers with nulls among them must not become doubles on the way.
            yield batch[["doc_id", "content"]].reset_index(drop=True).assign(
                n=n, **{"class": pd.array(classes, dtype="Int64"), "gr": pd.array(groups, dtype="Int64")}, prefix=prefixes, bitmap=bitmaps
            )

    return run


def _digest(shingles: np.ndarray, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed) - 2**63


# Links


def link_classes(docs: DataFrame, signed: DataFrame, words: int, least: tuple[int, int], every: bool = False) -> DataFrame:
    """a, b: links that connect all classes whose documents link; with ``every``, all links between classes."""
    sets = signed.where("n > 0")
    of_class = [F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("bitmap").alias("bitmap")]
    classes = store(sets.groupBy("class", "gr", "n").agg(*of_class), "jaccard-classes")
    groups = classes.groupBy("gr", "n").agg(F.count(F.lit(1)).alias("classes"), F.max("copies").alias("copies"), F.min("class").alias("class"))
    # Prefixes are most of a row; they are moved once, to their groups.
    groups = groups.join(sets.groupBy("gr").agg(F.first("prefix").alias("prefix")), "gr")
    groups = store(groups.withColumn("many", F.col("classes") > 1), "jaccard-groups")

    # A unit is a group, or, in the list of a group of several classes, one of its classes; told apart by ``many``.
    # Most shingles turn out to be in one prefix only. They are sorted out by their hashes alone, as far as a bitmap of
    # the shared ones tells, before anything else of an entry is moved.
    inner = classes.join(groups.where("many").select("gr"), "gr", "left_semi").select(
        F.xxhash64("gr").alias("list"), F.col("class").alias("unit_id"), "n", F.lit(0).alias("place"), F.lit(False).alias("many"), "copies",
        F.lit(0).cast("long").alias("previous"),
    )
    shared = groups.select(F.explode("prefix").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("list_size"))
    entries = groups.select(F.col("class").alias("unit_id"), "n", "many", "copies", "prefix").mapInPandas(
        _enter(marks(shared.where("list_size > 1"), F.col("list"))),
        "list bigint, unit_id bigint, n int, place int, many boolean, copies bigint, previous bigint",
    )
    listed = store(_listed(entries.unionByName(inner), least), "jaccard-listed")
    # Lists that may have a pair to look at.
    open_ = listed.where("not settled").select("list", "unit_id", "n", "place", "many", "previous")

    if every:
        maps = classes.select(F.col("class").alias("unit_id"), "bitmap", F.col("class").alias("root"))
        several = store(open_.groupBy("list").agg(F.count(F.lit(1)).alias("list_size")), "jaccard-apart")
        pairs = store(_pairs(open_, several, store(maps, "jaccard-known"), least), "jaccard-second")
        return verify(docs, classes, groups, pairs, words, least)

    led = listed.where("unit_id <> leader.unit_id or many <> leader.many")
    led = led.where(_sizes_fit(F.col("n"), F.col("leader.n"), least) & _places_fit(F.col("n"), F.col("place"), F.col("leader.n"), F.col("leader.place"), least))
    led = led.select(
        F.col("unit_id").alias("a"), F.col("many").alias("many_a"), "n", F.col("leader.unit_id").alias("b"), F.col("leader.many").alias("many_b"),
        F.col("leader.n").alias("n_b"),
    ).distinct()
    maps = classes.select(F.col("class").alias("unit_id"), "bitmap")
    for end in ("a", "b"):
        led = led.join(maps.select(F.col("unit_id").alias(end), F.col("bitmap").alias(f"bitmap_{end}")), end)
        led = led.withColumn(f"bitmap_{end}", F.when(~F.col(f"many_{end}"), F.col(f"bitmap_{end}")))
    first = led.mapInPandas(in_slices(_filter_bitmaps(least), 2048), f"{PAIR}, leader bigint")
    # A leader's pairs are verified together, in parts of about a block.
    beside = F.xxhash64("a", "b", F.lit(3))
    first = store(first.distinct(), "jaccard-first")
    blocks = first.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    first = first.join(blocks, "leader").select("a", "many_a", "b", "many_b", F.xxhash64("leader", F.pmod(beside, "blocks")).alias("unit"))
    first = store(_one_unit_each(first), "jaccard-first-units")
    links = verify(docs, classes, groups, first, words, least)

    # Where one comparison has not joined a list, every pair of it that is still apart is looked at, in the first list they share or
    # the first of a later run of lists.
    roots = components(links).select(F.col("node").alias("unit_id"), "root")
    # Roots are names of their own; a class without links is its own.
    known = store(maps.join(roots, "unit_id", "left").withColumn("root", F.coalesce("root", "unit_id")), "jaccard-known")
    apart = open_.join(known.select("unit_id", "root"), "unit_id").withColumn("root", F.when(~F.col("many"), F.col("root")))
    several = apart.groupBy("list").agg(
        F.count(F.lit(1)).alias("list_size"), F.min("root").alias("low_root"), F.max("root").alias("high_root"), F.max("many").alias("any_many")
    )
    several = store(several.where("any_many or low_root <> high_root").select("list", "list_size"), "jaccard-apart")
    second = _pairs(open_, several, known, least).join(first, ["a", "many_a", "b", "many_b"], "left_anti")
    return links.unionByName(verify(docs, classes, groups, store(second, "jaccard-second"), words, least))


def _listed(entries: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The entries whose list has another of a fitting size, with their list's leader and whether it is settled.

    Texts that meet by chance are mostly of unlike sizes, and the larger the corpus, the more of them meet; they go here, before entries
    are stored or moved again. If any size fits, the next smaller or the next larger of the list does.
    """
    by_size, whole = Window.partitionBy("list").orderBy("n"), Window.partitionBy("list")
    entries = entries.withColumns({"smaller": F.lag("n").over(by_size), "larger": F.lead("n").over(by_size)})
    smaller_fits = F.col("smaller").cast("long") * least[1] >= F.col("n").cast("long") * least[0]
    larger_fits = F.col("n").cast("long") * least[1] >= F.col("larger").cast("long") * least[0]
    entries = entries.where(F.coalesce(smaller_fits, F.lit(False)) | F.coalesce(larger_fits, F.lit(False))).drop("smaller", "larger")
    # The unit of the most copies leads its list.
    leader = F.max(F.struct("copies", "unit_id", "many", "n", "place")).over(whole)
    return entries.withColumns({"leader": leader, "settled": _settled(least, whole)}).drop("copies")


def _settled(least: tuple[int, int], rows: WindowSpec) -> Column:
    """Whether a list has no pair to look at: its rows have all come from one list before and met there, or in one before
    that, or it has two rows only, whose places rule them out."""
    low, high = F.min("previous").over(rows), F.max("previous").over(rows)
    most = F.min("place").over(rows) + F.min(F.col("n") - F.col("place")).over(rows)
    places_fit = most >= _needed(F.sum("n").over(rows), F.lit(0), least)
    return ((low == high) & (low != 0)) | ((F.count(F.lit(1)).over(rows) == 2) & ~places_fit)


def _pairs(entries: DataFrame, lists: DataFrame, known: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs to verify of these lists. Bitmaps, most of a row, are moved with what is left of the lists only.

    A group of several classes in a list of its own has its classes there; elsewhere it stands for all of them.
    """
    units = to_units(entries.withColumn("row", F.xxhash64("unit_id", "many")), lists, "list", "row", BLOCK).drop("row").join(known, "unit_id")
    units = units.withColumns({name: F.when(~F.col("many"), F.col(name)) for name in ("root", "bitmap")})
    return _one_unit_each(map_units(units, "list", _pairs_apart(least), UNIT_PAIR))


def marks(frame: DataFrame, hashed: Column) -> np.ndarray:
    """A bitmap of fixed size with a bit for each hash, at its last ``MARKS`` bits."""
    # The bitmap functions count from 1, in parts of 32,768 bits.
    number = hashed.bitwiseAND(F.lit((1 << MARKS) - 1)) + 1
    marked = frame.groupBy(F.bitmap_bucket_number(number).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    out = np.zeros(((1 << MARKS) // 32768, 4096), dtype=np.uint8)
    for row in marked.collect():  # 2^25 bits, whatever the corpus
        out[row.part - 1] = np.frombuffer(row.bits, dtype=np.uint8)
    return out.reshape(-1)


def _marked(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    at = hashed & ((1 << MARKS) - 1)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _enter(bits: np.ndarray):
    """The list entries of the groups' prefixes, but for those that the bitmap shows to be alone.

    ``previous`` is the list of the entry before in the same prefix, 0 for the first. Where the bitmap was wrong it may be a list of one
    row, which no two rows come from.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["prefix"].map(len).to_numpy()
            if not len(batch):
                continue
            shingles = np.concatenate(batch["prefix"].to_list())
            row = np.repeat(np.arange(len(batch)), lengths)
            place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            kept = np.flatnonzero(_marked(bits, shingles))
            about = batch[["unit_id", "n", "many", "copies"]].iloc[row[kept]].reset_index(drop=True)
            lists = shingles[kept]
            previous = np.zeros_like(lists)
            follows = row[kept][1:] == row[kept][:-1]
            previous[1:][follows] = lists[:-1][follows]
            about = about.assign(list=lists, place=place[kept].astype(np.int32), previous=previous)
            yield about[["list", "unit_id", "n", "place", "many", "copies", "previous"]]

    return run


PAIR = "a bigint, many_a boolean, b bigint, many_b boolean"
UNIT_PAIR = f"{PAIR}, unit bigint"


def _one_unit_each(pairs: DataFrame) -> DataFrame:
    """Pairs that were met in several units, in one of them."""
    return pairs.groupBy("a", "many_a", "b", "many_b").agg(F.min("unit").alias("unit"))


def _needed(n_a: Column, n_b: Column, least: tuple[int, int]) -> Column:
    """The least intersection of two sets of these sizes."""
    return F.ceil(F.lit(least[0]) * (n_a + n_b) / (least[0] + least[1]))


def _sizes_fit(n_a: Column, n_b: Column, least: tuple[int, int]) -> Column:
    return (F.least(n_a, n_b) * least[1]) >= (F.greatest(n_a, n_b) * least[0])


def _places_fit(n_a: Column, at_a: Column, n_b: Column, at_b: Column, least: tuple[int, int]) -> Column:
    """Whether enough shingles can be shared: those before the shared one, itself, and those after it."""
    most = F.least(at_a, at_b) + 1 + F.least(n_a - at_a - 1, n_b - at_b - 1)
    return most >= _needed(n_a, n_b, least)


def _differences(maps_a: list, maps_b: list) -> np.ndarray:
    """In how many bits bitmaps differ; the longer is folded to the length of the shorter. -1 where one is missing."""
    out = np.full(len(maps_a), -1, dtype=np.int64)
    for i, (one, other) in enumerate(zip(maps_a, maps_b, strict=True)):
        if one is not None and other is not None:
            x, y = (np.frombuffer(m, dtype=np.uint64) for m in (one, other))
            if len(x) != len(y):
                x, y = _folded(x, min(len(x), len(y))), _folded(y, min(len(x), len(y)))
            out[i] = int(np.bitwise_count(x ^ y).sum())
    return out


def _folded(bitmap: np.ndarray, length: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bitmap.reshape(-1, length), axis=0)


def most_differences(n_a: np.ndarray, n_b: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Shingles that two sets of these sizes may have apart."""
    total = n_a.astype(np.int64) + n_b.astype(np.int64)
    return total - 2 * -(-least[0] * total // (least[0] + least[1]))


def _ordered(a, many_a, b, many_b) -> pd.DataFrame:
    swap = (a > b) | ((a == b) & many_a & ~many_b)
    return pd.DataFrame(
        {"a": np.where(swap, b, a), "many_a": np.where(swap, many_b, many_a), "b": np.where(swap, a, b), "many_b": np.where(swap, many_a, many_b)}
    )


def _filter_bitmaps(least: tuple[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            apart = _differences(batch["bitmap_a"].tolist(), batch["bitmap_b"].tolist())
            kept = batch[apart <= most_differences(batch["n"].to_numpy(), batch["n_b"].to_numpy(), least)]
            ordered = _ordered(*(kept[c].to_numpy() for c in ("a", "many_a", "b", "many_b")))
            yield ordered.assign(leader=kept["b"].to_numpy()).drop_duplicates()

    return run


def _pairs_apart(least: tuple[int, int]):
    """The pairs of units' rows that pass every filter, are not known to be connected and have not met in the list before."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        columns = {c: frame[c].to_numpy() for c in ("unit", "side", "low", "high", "unit_id", "many", "n", "place", "previous")}
        root = frame["root"].astype("Int64").fillna(0).to_numpy(dtype=np.int64)
        single = ~frame["many"].to_numpy(dtype=bool)
        previous = columns["previous"]
        n, place, maps = columns["n"].astype(np.int64), columns["place"].astype(np.int64), frame["bitmap"].tolist()
        # A name for the unit that is the same in every frame.
        keys = frame[["list", "low", "high"]].astype("int64").to_numpy().view(np.uint64)
        named = _mixed(_mixed(keys[:, 0] + keys[:, 1] * _MIX) + keys[:, 2] * np.uint64(3)).view(np.int64)
        out = []
        for one, other in pairs_within(columns["unit"], columns["side"], columns["low"], columns["high"]):
            n_a, n_b = n[one], n[other]
            fit = ~(single[one] & single[other] & (root[one] == root[other]))
            fit &= (previous[one] == 0) | (previous[one] != previous[other])
            fit &= np.minimum(n_a, n_b) * least[1] >= np.maximum(n_a, n_b) * least[0]
            before = np.minimum(place[one], place[other])
            after = np.minimum(n_a - place[one], n_b - place[other])
            fit &= before + after >= -(-least[0] * (n_a + n_b) // (least[0] + least[1]))
            one, other = one[fit], other[fit]
            if len(one):
                apart = _differences([maps[i] for i in one], [maps[i] for i in other])
                fit = apart <= most_differences(n[one], n[other], least)
                one, other = one[fit], other[fit]
                out.append(_ordered(columns["unit_id"][one], ~single[one], columns["unit_id"][other], ~single[other]).assign(unit=named[one]))
        made = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["a", "many_a", "b", "many_b", "unit"])
        return made.astype({"a": "int64", "b": "int64", "many_a": bool, "many_b": bool, "unit": "int64"})

    return work


def verify(docs: DataFrame, classes: DataFrame, groups: DataFrame, pairs: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """a, b: the classes of the paired units that link, by their whole sets. A set is shipped once to each unit it has pairs in."""
    expanded = store(_expand(classes, groups, pairs), "jaccard-pairs")
    ends = expanded.select("unit", F.col("a").alias("class")).unionByName(expanded.select("unit", F.col("b").alias("class"))).distinct()
    large = ends.join(classes.select("class", "n"), "class").groupBy("unit").agg(F.ceil(F.sum("n") / UNIT_SHINGLES).cast("int").alias("parts"))
    large = store(large.where("parts > 1"), "jaccard-large")
    dealt = expanded.join(large, "unit", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = {name: F.pmod(F.xxhash64(end, F.lit(7)), F.col("parts")).cast("int") for name, end in (("low", "a"), ("high", "b"))}
    dealt = store(dealt.withColumns(part).drop("parts"), "jaccard-dealt")
    place = ["unit", "low", "high"]
    members = dealt.select(*place, F.col("a").alias("class")).unionByName(dealt.select(*place, F.col("b").alias("class"))).distinct()
    # Sets meet their units where they are made distinct, by class, and go on from there.
    members = _class_sets(docs, classes, members.select("class"), words).join(store(members, "jaccard-members"), "class")
    # In each unit the sets come before the pairs.
    rows = members.select(*place, F.col("class").alias("a"), F.lit(None).cast("long").alias("b"), "members").unionByName(
        dealt.select(*place, "a", "b", F.lit(None).cast("binary").alias("members"))
    )
    rows = rows.repartition(*place).sortWithinPartitions(*place, F.col("b").isNotNull())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        unit = None
        for batch in batches:
            units = list(zip(*(batch.column(c).to_pylist() for c in place), strict=True))
            ones, others, sets = batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("members")
            linked = []
            for i, (one, other) in enumerate(zip(ones, others, strict=True)):
                if units[i] != unit:
                    held, unit = {}, units[i]
                if other is None:
                    held[one] = np.frombuffer(sets[i].as_py(), np.uint64)
                elif _linked(held[one], held[other], least):
                    linked.append((one, other))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in linked], pa.int64()) for k in (0, 1)], names=["a", "b"])
            del batch, sets
            hand_back()

    return store(rows.mapInArrow(compare, "a bigint, b bigint"), "jaccard-links")


def _linked(a: np.ndarray, b: np.ndarray, least: tuple[int, int]) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return least[1] * shared >= least[0] * (len(a) + len(b) - shared)


def _expand(classes: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of units as pairs of classes. Only groups of several classes have anything to expand."""
    members = classes.join(groups.where("many").select("gr", F.col("class").alias("unit_id")), "gr").select("unit_id", "class")
    members = store(members, "jaccard-members")
    for end in ("a", "b"):
        several = pairs.where(f"many_{end}").join(members.withColumnRenamed("unit_id", end), end)
        several = several.drop(end).withColumnRenamed("class", end)
        pairs = pairs.where(f"not many_{end}").unionByName(several)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "unit").where("a <> b")
    return pairs.groupBy("a", "b").agg(F.min("unit").alias("unit"))


def _class_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """class, members: the sets of the wanted classes, made anew from one document each.

    The ids of these documents are marked in a bitmap of fixed size, so that the others' texts are
    neither shingled nor shuffled.
    """
    wanted = store(classes.select("class", "doc_id").join(wanted.distinct(), "class"), "jaccard-wanted")
    mark = F.xxhash64("doc_id")
    bits = marks(wanted, mark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"].to_numpy()[_marked(bits, batch["mark"].to_numpy())]:
                shingles = shingle_set(text, words)
                if len(shingles):
                    rows.append((_digest(shingles), shingles.tobytes()))
            yield pd.DataFrame(rows, columns=["class", "members"]).astype({"class": "int64"})

    made = docs.select("text", mark.alias("mark")).mapInPandas(in_slices(run), "class bigint, members binary")
    made = made.join(wanted.select("class"), "class", "left_semi")
    return made.dropDuplicates(["class"])
