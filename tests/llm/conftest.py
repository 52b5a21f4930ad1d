import random

import pytest
from pyspark.sql import functions as F

from seqwatch.llm.common import ship_package

#: Columns beside the documents' own, with names that operators use inside.
CLASHING = ("size", "shard", "row", "part", "n", "class", "key", "spans", "content", "times", "turn", "root", "ids", "copies", "list", "_kept_key", "_mix_key", "_pii_key", "_start")


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def prose(seed, n_words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n_words))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, source), with more columns whose names clash with the operators' own."""

    def make(rows, clashing=True):
        frame = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        return frame.withColumns({name: F.lit(f"other {name}") for name in CLASHING}) if clashing else frame

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated ids, equal texts and repeated rows."""
    base = prose(1, 120)
    return [
        (1, base, "a"), (2, base, "a"), (2, base, "a"), (3, base + " more", "b"), (4, None, "a"), (5, "", None), (6, " \t\n ", "b"), (6, "two words", "b"),
        (None, base, "c"), (None, None, None), (7, prose(2, 30_000, 5000), "c"), (8, "x" * 70_000, "c"), (9, "Two WORDS", "a"), (10, "é" * 500 + " ñ", None),
    ]
