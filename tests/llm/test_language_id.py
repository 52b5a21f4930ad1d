import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from seqwatch.llm import language_id
from seqwatch.llm.language_id import Alphabet, Automaton, Parser, suffix_automaton
from seqwatch.llm.queries import op13_language_id
from tests.llm.conftest import CLASHING


def words_of(letters, seed, n):
    rng = random.Random(seed)
    known = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    return lambda k: " ".join(random.Random(k).choices(known, k=n))


def parser_of(samples, alphabet):
    automata = []
    for sample in samples.values():
        table = suffix_automaton(alphabet.codes(sample), alphabet.size)
        state, code = np.nonzero(table)
        automata.append(Automaton(len(table), state.astype(np.int32).tobytes(), code.astype(np.uint8).tobytes(), table[state, code].tobytes()))
    return Parser(alphabet, list(samples), [len(alphabet.codes(s)) for s in samples.values()], automata)


def brute_phrases(sample, codes):
    """Phrases of a parse by the longest substrings of the sample, each run of it anew."""
    sample, phrases = bytes(sample), 0
    for at in range(0, len(codes), language_id.RUN):
        run, i = bytes(codes[at : at + language_id.RUN]), 0
        while i < len(run):
            n = 1
            while i + n < len(run) and run[i : i + n + 1] in sample:
                n += 1
            phrases, i = phrases + 1, i + n
    return phrases


def brute_best(samples, alphabet, text):
    codes = alphabet.codes(text) if text is not None else np.empty(0, np.uint8)
    if not codes.any():
        return "und", 0.0
    costs = sorted(
        (brute_phrases(alphabet.codes(s), codes) * math.log2(max(len(alphabet.codes(s)), 2)), lang) for lang, s in samples.items()
    )
    return costs[0][1], 1 - costs[0][0] / costs[1][0] if len(costs) > 1 else 1.0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc é.", min_size=1, max_size=40), min_size=1, max_size=3), st.lists(st.one_of(st.none(), st.text("abcdé 1中", max_size=60)), max_size=8))
def test_parse_is_the_longest_match(samples, texts):
    alphabet = Alphabet("abé")
    samples = {f"l{i}": s for i, s in enumerate(samples)}
    parser = parser_of(samples, alphabet)
    found, scores = parser.best(pa.array(texts, pa.string()))
    for text, lang, score in zip(texts, found, scores):
        expected = brute_best(samples, alphabet, text)
        assert lang == expected[0] and score == pytest.approx(expected[1])


def test_automaton_reads_every_substring_and_no_other():
    rng = random.Random(2)
    for _ in range(20):
        codes = np.array([rng.randrange(3) for _ in range(rng.randrange(1, 40))], np.uint8)
        table, sample = suffix_automaton(codes, 3), bytes(codes)
        assert len(table) <= 2 * len(codes)
        for _ in range(200):
            word, state = bytes(rng.randrange(3) for _ in range(rng.randrange(1, 6))), 0
            for c in word:
                state = table[state, c] if state is not None and table[state, c] else None
                if state is None:
                    break
            assert (state is not None) == (word in sample)


def test_long_texts_and_small_groups_of_runs(monkeypatch):
    monkeypatch.setattr(language_id, "RUN", 50)
    monkeypatch.setattr(language_id, "TOGETHER", 130)
    samples = {"x": words_of("abcd", 1, 80)(1), "y": words_of("bcde", 2, 80)(1)}
    alphabet = Alphabet("abcde")
    texts = [words_of("abcd", 1, 100)(5), words_of("bcde", 2, 90)(6), "", None, "a", "zz" * 200]
    found, scores = parser_of(samples, alphabet).best(pa.array(texts))
    for text, lang, score in zip(texts, found, scores):
        assert (lang, pytest.approx(score)) == brute_best(samples, alphabet, text)


def corpus():
    made = {"xx": words_of("abcdefgh", 1, 40), "yy": words_of("efghijkl", 2, 40), "zz": words_of("ßàçéèüñ", 3, 40)}
    return [(i, made[lang](i), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 60)]


def frame_of(spark, rows, clashing=True):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return frame.selectExpr("*", *[f"'other' as `{c}`" for c in dict.fromkeys((*CLASHING, "held_out", "piece", "place", "score"))]) if clashing else frame


def test_held_out_documents_are_told(spark):
    out = language_id.identify(frame_of(spark, corpus())).collect()
    truth = {i: lang for i, _, lang in corpus()}
    assert len(out) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert all(r.lang_pred == truth[r.doc_id] and 0 < r.score <= 1 for r in out)


def test_held_out_labels_teach_nothing(spark):
    rows = corpus()
    wrong = [(i, t, "wrong" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    right = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(frame_of(spark, rows)).collect()}
    assert {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(frame_of(spark, wrong)).collect()} == right


def test_odd_rows(spark):
    rows = corpus() + [
        (1000, None, "xx"), (1001, "", "yy"), (1002, " 12 ?!\n", "xx"), (None, "abc dab", "qq"), (1003, "abcd " * 40_000, None), (1004, "中文", "zz"),
        (1005, "ABCDEFGH HGFEDCBA", None), (1005, "ABCDEFGH HGFEDCBA", None), (1006, "é" * 70_000, "zz"),
    ]
    out = language_id.identify(frame_of(spark, rows)).collect()
    assert sorted(map(str, [r.doc_id for r in out])) == sorted(str(i) for i, _, _ in rows)
    by_id = {r.doc_id: r for r in out}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1000, 1001, 1002))
    assert by_id[None].held_out is False and by_id[None].lang_pred == "xx" and by_id[1003].lang_pred == "xx" and by_id[1005].lang_pred == "xx"
    assert by_id[1006].lang_pred == "zz" and by_id[1004].lang_pred in ("xx", "yy", "zz")
    assert "qq" not in {r.lang_pred for r in out}


def test_nothing_learnt_and_empty(spark):
    out = language_id.identify(frame_of(spark, [(1, "words here", None), (2, None, "xx")])).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in out} == {(1, "und", 0.0), (2, "und", 0.0)}
    one = language_id.identify(frame_of(spark, [(1, "words here", "xx"), (2, "others", None)])).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("xx", 1.0)}
    empty = language_id.identify(frame_of(spark, []))
    assert empty.collect() == [] and dict(empty.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}


def test_given_table(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in op13_language_id(spark, folder).collect() if r.held_out]
    assert len(out) > 200 and sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.98 * len(out)
