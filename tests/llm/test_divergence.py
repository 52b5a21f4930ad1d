import re
from collections import Counter, defaultdict

import pytest

from seqwatch.checks.compare import connect, oracle_rows, spark_rows
from seqwatch.llm import divergence
from seqwatch.llm.oracle import ORACLE
from seqwatch.llm.queries import op12_divergence
from tests.llm.conftest import CLASHING, prose

SF_DIR = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, listed):
    """(lang, source, text) rows to the audit's, by whole shares of every term."""
    rows = [(lang or "", source or "", text or "") for lang, source, text in rows]
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
        found = TERM.findall(lowered)
        counts[lang, source].update(found)
        counts[lang, None].update(found)
        documents[lang].update(set(found))
    out = []
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in documents[lang].items() if n >= least]
        sources = sorted({r[1] for r in rows if r[0] == lang}, key=str.encode)

        def shares(source):
            total = sum(counts[lang, source][t] for t in kept)
            return {t: 1 + 10**9 * (counts[lang, source][t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(s) for s in sources}, shares(None)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, i, -v, r + 1) for r, (v, i) in enumerate(ranked) if part == "pair" or r < listed]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


def make(spark, rows, clashing=False):
    frame = spark.createDataFrame([(i, t, la, s) for i, (la, s, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string")
    names = [c for c in (*CLASHING, "term", "mark", "part_", "value", "p", "none", "copies") if c not in frame.columns]
    return frame.selectExpr("*", *[f"'other' as `{c}`" for c in dict.fromkeys(names)]) if clashing else frame


def test_against_sql(spark):
    with connect(SF_DIR) as duck:
        assert spark_rows(op12_divergence(spark, SF_DIR)) == oracle_rows(duck, ORACLE["op12_divergence"])


@pytest.mark.parametrize("held", [400_000, 3])
def test_copies_in_many_sources(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rows = [("en", f"s{i % 7}", prose(i % 40, 30, 60)) for i in range(300)]
    rows += [("en", f"s{i % 5}", "the hot text of all sources w1 w1 w2") for i in range(200)]
    rows += [("fr", f"s{i % 3}", "the hot text of all sources w1 w1 w2") for i in range(20)]
    assert rows_of(divergence.audit(make(spark, rows), 10, 8)) == brute(rows, 10, 8)


def test_odd_rows(spark):
    rows = [("en", "a", "Ärger ÄRGER abc ABC a1b"), ("en", "a", "Ärger ÄRGER abc ABC a1b"), ("en", "b", None), ("en", None, ""), (None, None, None)]
    rows += [("en", "c", "... 123"), ("", "z", "abc 日本語 x"), (None, "y", "abc 日本語"), ("de", "only", "eins zwei"), ("de", "only", "eins drei")]
    rows += [("en", "long", "w " * 60_000 + "x" * 70_000), ("en", "ties", "t1a t1b t1c"), ("en", "ties", "t1a t1b t1c")]
    for least in (1, 2, 100):
        assert rows_of(divergence.audit(make(spark, rows, True), least, 3)) == brute(rows, least, 3)


def test_empty(spark):
    out = divergence.audit(make(spark, []))
    assert out.collect() == []
    assert dict(out.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


def test_marks_shared_by_other_texts(spark, monkeypatch):
    """All texts on one mark: none is counted where it stands, and results are the same."""
    rows = [("en", f"s{i % 4}", prose(i % 50, 20, 30)) for i in range(80)]
    monkeypatch.setattr(divergence, "_marked", lambda bits, hashed: hashed == hashed)
    assert rows_of(divergence.audit(make(spark, rows), 5, 10)) == brute(rows, 5, 10)


def test_shares_do_not_overflow(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(9 * 10**17, 10**18, 1000), (0, 0, 3), (7, 7, 1)], "c bigint, n bigint, v bigint")
    got = [r.s for r in frame.select(divergence._share(F.col("c"), F.col("n"), F.col("v")).alias("s")).collect()]
    assert got == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in ((9 * 10**17, 10**18, 1000), (0, 0, 3), (7, 7, 1))]
