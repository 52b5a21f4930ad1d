"""Encode texts with a public tokenizer and decode them again, long texts by tree concatenation.

A long text is halved until its pieces are short, the pieces are encoded in parallel, and neighbours are
joined up the tree. At a join a window of text around the cut is encoded anew; it grows until, on either
side, there is a place where the window's tokens and the side's tokens go on alike. Left of the
first such place the left side's tokens hold, right of the second the right side's, between them the window's.

Why that is exact: a sequence of tokens is the encoding of its text if each pair of neighbours is the
encoding of theirs. A place of agreement has the same token before and after it in both encodings, so every pair
of the joined sequence is a pair of one of the three. White space is always such a place.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from seqwatch.llm.common import hand_back

#: Texts of more code points are cut.
LEAF = 65_536
#: Half the first window, in code points.
WINDOW = 128
#: How far a place of agreement within a word is from the ends of both encodings, so that both have seen any special token beside it.
MARGIN = 32
#: Words whose ids a task remembers; beyond it starts anew, but for those of the last so many that are met again.
REMEMBERED = 60_000
#: Words of more code points are not remembered: they are many, each is seldom met again, and so many of them take much memory.
LONGEST = 48
#: Code points encoded at a time.
AT_ONCE = 500_000

BLANKS = " \t\n\r\x0b\x0c"


def encode(docs: DataFrame, tokenizer: str, leaf: int = LEAF, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text, as the tokenizer file's own encoding without added special tokens.

    A null text counts as empty; an empty text has no ids. Special tokens written out in a text become their ids, as
    in the library. Null and repeated ids and repeated rows each keep their row. An empty table gives an
    empty result. Other columns are ignored. The file must be readable at the same path on every executor.
    Texts are cut only for tokenizers that drop white space; others encode each text whole.
    """
    return _encoded(docs, tokenizer, leaf, doc_id, text, "ids array<int>", _Ids())


def _encoded(docs: DataFrame, tokenizer: str, leaf: int, doc_id: str, text: str, schema: str, kind) -> DataFrame:
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    key = narrow.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[column.split()[0] for column in schema.split(", ")]]
    length = F.length("text")
    encode_rows = _encode_rows(tokenizer, kind, names)
    if not Codec.of(tokenizer).by_word:
        return narrow.mapInArrow(encode_rows, f"doc_id {key}, {schema}")
    short = narrow.where(length <= leaf).mapInArrow(encode_rows, f"doc_id {key}, {schema}")

    # Equal long texts are encoded once. Pieces of a text meet again by its digest.
    long = narrow.where(length > leaf).select("doc_id", F.sha2("text", 256).alias("content"), "text")
    pieces = long.groupBy("content").agg(F.first("text").alias("text")).mapInPandas(_halve(leaf), "content string, piece int, text string")
    # A number of its own keeps adaptive execution from making one task of pieces that are few but long.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded = pieces.repartition(tasks, "content", "piece").mapInPandas(
        _encode_pieces(tokenizer), "content string, piece int, text string, ids array<int>, starts array<int>, ends array<int>"
    )
    joined = encoded.groupBy("content").applyInPandas(_concatenate(tokenizer, kind, ["content", *names[1:]]), f"content string, {schema}")
    return short.unionByName(long.select("doc_id", "content").join(joined, "content").select(*names))


def decode(ids, tokenizer: str):
    """The text of a column of ids, with special tokens."""

    @pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        codec = Codec.of(tokenizer)
        return column.map(lambda x: None if x is None else codec.decode(x))

    return decoded(ids)


def digests(docs: DataFrame, tokenizer: str, leaf: int = LEAF, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids in decimal, joined by blanks), decoded_sha256 (of the decoded text), as ``encode`` has the ids."""
    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs, tokenizer, leaf, doc_id, text, schema, _Digests())


class _Ids:
    """Rows of ids."""

    def of_word(self, codec: Codec, ids: list[int]) -> tuple:
        return tuple(ids)

    def columns(self, codec: Codec, texts: list[list[tuple]]) -> list[pa.Array]:
        sizes = [sum(map(len, words)) for words in texts]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        values = np.fromiter((i for words in texts for word in words for i in word), dtype=np.int32, count=offsets[-1])
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]


class _Digests:
    """Rows of counts and digests, from the parts that each word adds to the written ids and to the decoded text."""

    def of_word(self, codec: Codec, ids: list[int]) -> tuple:
        if not ids:
            return ()
        # The ids themselves are wanted only where a decoder puts them together.
        if len(ids) == 1:
            return (1, codec.numerals[ids[0]], codec.tokens[ids[0]], None if codec.plain else ids)
        return (len(ids), " ".join([codec.numerals[i] for i in ids]), " ".join([codec.tokens[i] for i in ids]), None if codec.plain else ids)

    def columns(self, codec: Codec, texts: list[list[tuple]]) -> list[pa.Array]:
        rows = []
        for words in texts:
            counts, written, tokens, ids = zip(*words, strict=True) if words else ((),) * 4
            decoded = " ".join(tokens) if codec.plain else codec.decode([i for word in ids for i in word])
            rows.append((sum(counts), _sha256(" ".join(written)), _sha256(decoded)))
        counts, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
        return [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


class Codec:
    """A tokenizer of a worker, with the words it has met."""

    _known: dict[str, Codec] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        #: Whether blanks only separate words: no token, special token or composed character then spans one.
        self.by_word = layout["normalizer"] == WORD_NORMALIZER and layout["pre_tokenizer"] == WORD_PRE_TOKENIZER
        del layout
        self.model = self.tokenizer.model
        # Without a decoder the library sets blanks between tokens.
        self.plain = self.tokenizer.decoder is None
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.numerals = [str(i) for i in range(size)]
        #: What was made of words, since the last start anew and before it.
        self.words: dict[type, tuple[dict[str, tuple], dict[str, tuple]]] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def encode(self, texts: list[str], kind) -> list[list[tuple]]:
        """What ``kind`` makes of each word, for whole texts; words without tokens are left out."""
        if not self.by_word:
            whole = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [[kind.of_word(self, made.ids)] if made.ids else [] for made in whole]
        split = [_blanked(text).split(" ") for text in texts]
        known, before = self.words.get(type(kind), ({}, {}))
        if len(known) > REMEMBERED:
            known, before = {}, known
        self.words[type(kind)] = known, before
        new = set().union(*split).difference(known)
        met = {word: before[word] for word in new if word in before}
        known.update(met)
        for word, ids in self._ids(new.difference(met)):
            known[word] = kind.of_word(self, ids)
        made = [list(filter(None, map(known.__getitem__, words))) for words in split]
        for word in new:
            if len(word) > LONGEST:
                del known[word]
        return made

    def forget(self) -> None:
        """Without the words met so far."""
        self.words.clear()

    def _ids(self, words: set[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of words. A run of common letters and the marks after it are two pieces, which the model takes as they are."""
        for word in words:
            if found := SIMPLE.fullmatch(word):
                yield word, self._piece(found[1].lower()) + (self._piece(found[2]) if found[2] else [])
            else:
                # Not as a batch: that takes threads, each of which keeps a heap, and holds all that was made at once.
                yield word, self.tokenizer.encode(word, add_special_tokens=False).ids

    def _piece(self, piece: str) -> list[int]:
        # Pieces have no ASCII but letters and marks, which stand for themselves.
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return [token.id for token in self.model.tokenize(piece)]

    def encode_with_places(self, text: str, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends of a piece's tokens; the piece begins at ``at``."""
        made = self.tokenizer.encode(text, add_special_tokens=False)
        places = np.array(made.offsets, dtype=np.int32).reshape(-1, 2) + at
        return np.array(made.ids, dtype=np.int32), places[:, 0], places[:, 1]

    def decode(self, ids) -> str:
        if self.plain:
            tokens = self.tokens
            return " ".join([tokens[i] for i in ids])
        return self.tokenizer.decode(list(ids), skip_special_tokens=False)


def _byte_letters() -> dict[int, str]:
    """Byte-level pieces: bytes that are printable stand for themselves, the others for the letters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in printable]
    return {byte: chr(byte) for byte in printable} | {byte: chr(0x100 + i) for i, byte in enumerate(others)}


def _blanked(text: str) -> str:
    """With blanks for white space. Whole passes for one character each take less than a table for all."""
    for blank in BLANKS[1:]:
        text = text.replace(blank, " ")
    return text


_BYTE_LETTERS = _byte_letters()
#: Letters up to U+017F, which neither compose nor depend on their neighbours in lower case (but for U+0130), and marks.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([.,;:!?]*)")

# How a tokenizer file says that it lower-cases, drops white space and cuts at letters, digits and marks.
WORD_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
WORD_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _encode_rows(tokenizer: str, kind, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(tokenizer)
        for batch in batches:
            lengths = np.asarray(pa.compute.utf8_length(batch.column("text")))
            groups = np.cumsum(lengths) // AT_ONCE
            for group in np.unique(groups):
                rows = np.flatnonzero(groups == group)
                part = batch.slice(rows[0], len(rows))
                made = kind.columns(codec, codec.encode(part.column("text").to_pylist(), kind))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], names=names)
                # A part holds its whole batch, beside the next one.
                del made, part
            del batch
            hand_back()
        # Workers live on, idle or in other stages, beside heaps that have grown meanwhile.
        codec.forget()
        gc.collect()
        hand_back()

    return run


def halves(text: str, leaf: int) -> list[str]:
    """The text, halved until no piece is longer than ``leaf``."""
    if len(text) <= leaf:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], leaf) + halves(text[middle:], leaf)


def _halve(leaf: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                pieces = halves(row.text, leaf)
                yield pd.DataFrame({"content": [row.content] * len(pieces), "piece": range(len(pieces)), "text": pieces})
            del batch
            hand_back()

    return run


def _encode_pieces(tokenizer: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(tokenizer)
        for batch in batches:
            for at in range(len(batch)):
                piece = batch.iloc[at : at + 1].copy()
                ids, starts, ends = codec.encode_with_places(piece["text"].iat[0], 0)
                piece["ids"], piece["starts"], piece["ends"] = [ids], [starts], [ends]
                yield piece
            del batch
            hand_back()

    return run


def _concatenate(tokenizer: str, kind, names: list[str]):
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        codec = Codec.of(tokenizer)
        pieces = pieces.sort_values("piece")
        ids = concatenate(codec, pieces["text"].tolist(), list(zip(pieces["ids"], pieces["starts"], pieces["ends"], strict=True)))
        word = kind.of_word(codec, ids.tolist())
        made = [column.to_pylist() for column in kind.columns(codec, [[word] if word else []])]
        return pd.DataFrame(dict(zip(names, [list(key), *made], strict=True)))

    return run


def concatenate(codec: Codec, pieces: list[str], encoded: list[tuple]) -> np.ndarray:
    """The ids of the whole text from the encodings of its pieces (ids, starts, ends within the piece)."""
    text = "".join(pieces)
    begins = np.concatenate([[0], np.cumsum([len(piece) for piece in pieces])]).astype(int).tolist()
    sides = [
        (low, high, np.asarray(ids), np.asarray(starts) + low, np.asarray(ends) + low)
        for low, high, (ids, starts, ends) in zip(begins[:-1], begins[1:], encoded, strict=True)
    ]
    while len(sides) > 1:
        pairs = zip(sides[::2], sides[1::2], strict=False)
        sides = [join(codec, text, left, right) for left, right in pairs] + ([sides[-1]] if len(sides) % 2 else [])
    return sides[0][2]


def join(codec: Codec, text: str, left: tuple, right: tuple) -> tuple:
    """One encoding of two neighbours, each (low, high, ids, starts, ends)."""
    low, cut, high = left[0], left[1], right[1]
    half = WINDOW
    while True:
        begin, end = max(low, cut - half), min(high, cut + half)
        window = (begin, end, *codec.encode_with_places(text[begin:end], begin))
        # Where the window begins or ends with a side, it stands for all of that side.
        first = low if begin == low else _agreement(text, left, window, begin, cut, last=True)
        second = high if end == high else _agreement(text, window, right, cut, end, last=False)
        if first is not None and second is not None:
            kept = left[3] < first, (window[3] >= first) & (window[3] < second), right[3] >= second
            parts = [[side[i][mask] for side, mask in zip((left, window, right), kept, strict=True)] for i in (2, 3, 4)]
            return (low, high, *[np.concatenate(part) for part in parts])
        half *= 2


def _agreement(text: str, one: tuple, other: tuple, begin: int, end: int, last: bool) -> int | None:
    """A place between ``begin`` and ``end`` from which both encodings go on alike, the one nearest to the cut.

    ``one`` ends at ``end`` and ``other`` starts at ``begin``, or they reach beyond.
    """
    places = range(end - 1, begin, -1) if last else range(begin + 1, end)
    for place in places:
        if text[place - 1] in BLANKS or text[place] in BLANKS:
            return place
    near = range(end - MARGIN, begin + MARGIN, -1) if last else range(begin + MARGIN, end - MARGIN)
    around = [_neighbours(side, begin, end) for side in (one, other)]
    for place in near:
        pair = around[0].get(place)
        if pair is not None and pair == around[1].get(place) and _settled(text, place):
            return place
    return None


def _neighbours(side: tuple, begin: int, end: int) -> dict[int, tuple]:
    """Place -> the tokens that meet there, with their outer ends."""
    _, _, ids, starts, ends = side
    at = np.flatnonzero((starts[1:] > begin) & (starts[1:] < end) & (starts[1:] == ends[:-1])) + 1
    # A character of several tokens has one place for all of them: no boundary.
    at = at[(starts[at] > starts[at - 1]) & (ends[at] > starts[at])]
    return {
        int(starts[i]): (int(ids[i - 1]), int(starts[i - 1]), int(ids[i]), int(ends[i]))
        for i in at
        if (i + 1 >= len(starts) or starts[i + 1] > starts[i]) and (i < 2 or starts[i - 2] < starts[i - 1])
    }


def _settled(text: str, place: int) -> bool:
    """Whether composing characters has no effect across the place."""
    pair = text[place - 1 : place + 1]
    return not unicodedata.combining(pair[1]) and unicodedata.normalize("NFC", pair) == pair
