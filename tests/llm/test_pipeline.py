"""The stages one by one, each against a brute-force version or its own rule, on a small table of documents."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from seqwatch.llm.common import store
from seqwatch.llm.queries import tokenizer_path

from .test_jaccard import brute
from .test_mixing import words
from .test_pii import base

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def passed(spark):
    """What each stage got and returned."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = store(stage(spark, docs, SF_DIR), f"test-{name}")
        out[name] = (docs, made)
        docs = made
    return out


def test_stages_and_columns(passed):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "pii", "mixing", "bpe"]
    first = passed["toxicity"][0].columns
    assert all(made.columns == first for name, (_, made) in passed.items() if name != "bpe")
    assert all(made.count() for _, made in passed.values())


def test_toxicity(spark, passed):
    before, after = passed["toxicity"]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    kept = {r.doc_id for r in after.collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    # Fifty toxic examples teach only the commonest terms; test_classifiers has the accuracy on a larger table.
    assert len(kept & toxic) <= 0.35 * len(toxic) and len(clean - kept) <= 0.01 * len(clean)


def test_join_keeps_one_of_each_group(passed):
    before, after = passed["ngram_jaccard_join"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    sets, smallest = brute(rows, 5, (80, 100))
    assert {r.doc_id for r in after.collect()} == {i for (i, _), c in zip(rows, smallest) if i == c}
    assert after.count() == len(set(smallest))


def test_pii(passed):
    before, after = passed["pii"]
    texts = {r.doc_id: r for r in after.collect()}
    assert len(texts) == before.count()
    for r in before.collect():
        spans = base(r.text)
        if not spans:
            assert texts[r.doc_id].text == r.text
        else:
            assert not any(r.text[a:b] in texts[r.doc_id].text for k, a, b in spans if k == "email")
            assert texts[r.doc_id].n_chars == len(texts[r.doc_id].text)


def test_mixing(passed):
    before, after = passed["mixing"]
    copies = Counter(r.doc_id for r in after.collect())
    assert set(copies) <= {r.doc_id for r in before.collect()} and max(copies.values()) <= 2
    total = sum(words(r.text) for r in before.collect())
    assert sum(words(r.text) for r in after.collect()) == pytest.approx(1.5 * total, rel=0.05)


def test_bpe(passed):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    before, after = passed["bpe"]
    wanted = Counter()
    for r in before.collect():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        wanted[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in after.collect()) == wanted


def test_run_is_the_stages_in_turn(spark, passed):
    assert sorted(map(repr, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(repr, passed["bpe"][1].collect()))
