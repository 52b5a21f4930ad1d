import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from seqwatch.llm import bpe
from seqwatch.llm.queries import op10_bpe, tokenizer_path

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_whole_table(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op10_bpe(spark, SF_DIR).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: expected(library, t) for i, t in texts.items()}


def test_odd_rows_and_long_texts(make_docs, odd_rows, library):
    special = [(20, "a<|startoftext|>b <|endoftext|>", "a"), (21, "don't we'll 'tis x y\x1cz", "a"), (22, "é İstanbul ΣΑΣ ﬁ 12345 ½ 你好👩‍👩‍👧", "a")]
    rows = odd_rows + special
    out = bpe.digests(make_docs(rows), tokenizer_path()).collect()
    assert sorted(map(repr, (tuple(r) for r in out))) == sorted(repr((i, *expected(library, t))) for i, t, _ in rows)
    assert bpe.digests(make_docs([]), tokenizer_path()).collect() == []


def test_cut_texts_are_as_whole_ones(make_docs, odd_rows, library):
    """Every text of more than 40 code points goes through the tree, with repeated rows."""
    out = bpe.encode(make_docs(odd_rows), tokenizer_path(), leaf=1000).collect()
    assert sorted(repr((r.doc_id, r.ids)) for r in out) == sorted(
        repr((i, library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in odd_rows
    )


LETTERS = st.sampled_from(["the", "ing", "re", "'s", "'", "!", "'re", "st", "a", "é", "é", "1", "23", "你", "👍", "<|endoftext|>", "<|", "-", "zz"])


@settings(max_examples=150, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=400), st.booleans(), st.integers(5, 60))
def test_tree_is_exact_on_unsplit_text(parts, blanks, leaf):
    codec = bpe.Codec.of(tokenizer_path())
    text = (" " if blanks and len(parts) > 50 else "").join(parts) * 2
    pieces = bpe.halves(text, leaf)
    encoded = [codec.encode_with_places(piece, 0) for piece in pieces]
    assert bpe.concatenate(codec, pieces, encoded).tolist() == codec.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnopqrstuvwxyz", "éèàbcdst", "ing'", "!?-'.", "你好吗a"])
def test_windows_stay_small_on_long_words(alphabet):
    codec = bpe.Codec.of(tokenizer_path())
    rng = random.Random(3)
    text = "".join(rng.choice(alphabet) for _ in range(20_000))
    pieces = bpe.halves(text, 2500)
    assert bpe.concatenate(codec, pieces, [codec.encode_with_places(p, 0) for p in pieces]).tolist() == codec.tokenizer.encode(
        text, add_special_tokens=False
    ).ids


def test_common_words_are_as_in_the_library(library):
    """Every letter and mark that the short way takes, in words with marks after them."""
    codec = bpe.Codec.of(tokenizer_path())
    letters = [chr(i) for i in range(0x180) if bpe.SIMPLE.fullmatch(chr(i))]
    assert "\u0130" not in letters and len(letters) > 200
    words = [a + b + mark for a in letters for b, mark in (("", "."), ("St", ","), (a, "?!"), ("x", ""))]
    assert dict(codec._ids(set(words))) == {w: library.encode(w, add_special_tokens=False).ids for w in words}


def test_round_trip_of_ids(spark, make_docs):
    docs = make_docs([(1, "hello there", "a"), (2, None, "a")], clashing=False)
    out = bpe.encode(docs, tokenizer_path()).withColumn("back", bpe.decode(F.col("ids"), tokenizer_path())).orderBy("doc_id").collect()
    assert [r.back for r in out] == ["hello</w> there</w>", ""]


def test_other_decoders(tmp_path):
    """A tokenizer file with a decoder is decoded by the library."""
    import public_tokenizers

    codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    ids = codec.tokenizer.encode("hello there").ids
    assert not codec.by_word and codec.encode(["hello there", ""], bpe._Ids()) == [[tuple(ids)], []]
    assert codec.decode(ids) == codec.tokenizer.decode(ids, skip_special_tokens=False)


def test_words_met_again_are_remembered(monkeypatch):
    """A full memory is not emptied of the words that texts go on with."""
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    codec, kind, asked = bpe.Codec(tokenizer_path()), bpe._Ids(), []
    ids_of = codec._ids
    monkeypatch.setattr(codec, "_ids", lambda words: asked.extend(words) or ids_of(words))
    texts = [["the of and to"], ["the of x"], ["the y"], ["the of\tz the"]]
    made = [codec.encode(text, kind) for text in texts]
    assert asked.count("the") == 1 and max(len(part) for part in codec.words[bpe._Ids]) < 8
    assert [[i for word in words for i in word] for batch in made for words in batch] == [codec.tokenizer.encode(t[0], add_special_tokens=False).ids for t in texts]


def test_a_task_leaves_no_words_behind():
    """A worker lives on in stages that have no use for what it has met."""
    codec = bpe.Codec.of(tokenizer_path())
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["the of\tand to", "words met once only"]})
    out = list(bpe._encode_rows(tokenizer_path(), bpe._Digests(), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])(iter([batch])))
    assert sum(part.num_rows for part in out) == 2 and not codec.words


def test_memory_is_bounded_for_long_words(library):
    """Texts without blanks are one word each; remembering them would hold all texts."""
    codec, rng = bpe.Codec(tokenizer_path()), random.Random(5)
    texts = ["".join(rng.choice("abcdefghijé1你") for _ in range(3000)) + " the the" for _ in range(40)]
    made = codec.encode(texts, bpe._Ids())
    assert [[i for word in words for i in word] for words in made] == [library.encode(text, add_special_tokens=False).ids for text in texts]
    known = codec.words[bpe._Ids][0]
    assert "the" in known and sum(map(len, known)) < 3000
