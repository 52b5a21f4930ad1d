"""Names that are nearly the same: the nearest name for each one that has no match."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from seqwatch.functions.cases import normalise_name


@cache
def _accented() -> tuple[str, str]:
    """Letters that are a base letter and marks, and their base letters: by the rule of Unicode's decomposition, up to its Latin blocks."""
    pairs = []
    for point in range(0xC0, 0x250):
        base, *marks = unicodedata.normalize("NFD", chr(point))
        if marks and all(unicodedata.combining(mark) for mark in marks):
            pairs.append((chr(point), base))
    return "".join(one for one, _ in pairs), "".join(base for _, base in pairs)


def without_accents(text: Column) -> Column:
    """Latin letters without their marks, written in one piece or behind the letter."""
    return F.translate(F.regexp_replace(text, "[\\u0300-\\u036f]", ""), *_accented())


def nearest_names(names: DataFrame, known: DataFrame, most: int = 2, name: str = "name", known_name: str = "name") -> DataFrame:
    """name, nearest, distance: for every name that isn't known, the known one it is nearest to.

    Names are compared trimmed, in upper case and without accents, as ``folded`` does. The distance counts letters put in, left out or changed; more
    than ``most`` is no match (NULL in both columns), of equally near names the first stays. A name that is known once folded has distance 0. Names that are
    known as they stand, and NULL, have no row.

    Candidates are joined by equal pieces: cut into ``most`` + 1 pieces, one of a name's pieces is whole in any name within the distance, not
    more than ``most`` places away. So no pair is missed, and none is looked at that shares no piece in its place.
    """
    if most < 0:
        raise ValueError("most is not negative")
    wanted = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    known = known.select(F.col(known_name).alias("nearest")).where("nearest is not null").distinct()
    wanted = wanted.join(known, wanted["name"] == known["nearest"], "left_anti").withColumn("folded", folded(F.col("name")))
    known = known.withColumn("folded_known", folded(F.col("nearest")))
    # Spellings that fold to the same are compared once.
    targets = known.groupBy("folded_known").agg(F.min("nearest").alias("nearest"))
    sought = wanted.select("folded").distinct()
    pairs = candidates(sought, targets.select("folded_known"), most)
    near = pairs.withColumn("distance", F.levenshtein("folded", "folded_known", most)).where("distance >= 0")
    found = near.join(targets, "folded_known").groupBy("folded").agg(F.min(F.struct("distance", "nearest")).alias("best"))
    return wanted.join(found, "folded", "left").select("name", "best.nearest", "best.distance")


def folded(name: Column) -> Column:
    return without_accents(normalise_name(name))


def candidates(sought: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """folded, folded_known: the pairs of texts that share a piece in about the same place, each once."""
    pieces = most + 1
    size = F.length("folded_known")
    target = targets.select("folded_known", size.alias("size"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("piece"), _start(size, k, pieces).alias("start"), _piece(F.col("folded_known"), _start(size, k, pieces), _size(size, k, pieces)).alias("text"))
        for k in range(pieces)
    ])))
    # The places where a piece of a name of each near length can stand in the sought name.
    length = F.length("folded")
    sizes = F.sequence(F.greatest(length - most, F.lit(0)), length + most)
    sized = sought.select("folded", F.explode(sizes).alias("size"))
    placed = sized.select("folded", "size", F.inline(F.array(*[
        F.struct(F.lit(k).alias("piece"), _start(F.col("size"), k, pieces).alias("start"), _size(F.col("size"), k, pieces).alias("long")) for k in range(pieces)
    ])))
    first, last = F.greatest(F.col("start") - most, F.lit(0)), F.least(F.col("start") + most, F.length("folded") - F.col("long"))
    shifted = placed.where(first <= last).withColumn("at", F.explode(F.sequence(first, last)))
    source = shifted.select("folded", "size", "piece", _piece(F.col("folded"), F.col("at"), F.col("long")).alias("text")).distinct()
    return source.join(target.select("folded_known", "size", "piece", "text"), ["size", "piece", "text"]).select("folded", "folded_known").distinct()


def _start(size: Column, k: int, pieces: int) -> Column:
    """Where piece ``k`` of a text starts, from 0: the first pieces are the shorter ones."""
    short = F.floor(size / pieces).cast("int")
    longer = F.pmod(size, F.lit(pieces))
    return short * k + F.greatest(F.lit(k) - (F.lit(pieces) - longer), F.lit(0))


def _size(size: Column, k: int, pieces: int) -> Column:
    short = F.floor(size / pieces).cast("int")
    return short + F.when(F.lit(k) >= F.lit(pieces) - F.pmod(size, F.lit(pieces)), 1).otherwise(0)


def _piece(text: Column, start: Column, size: Column) -> Column:
    return F.substr(text, start + 1, size)
