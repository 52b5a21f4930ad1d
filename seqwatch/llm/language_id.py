"""Language identification by cross-parsing entropy.

Each language has the suffix automaton of a bounded sample of its labelled texts, which knows every substring of the sample. A text is parsed
by it from left to right into phrases, each the longest match from where the last one ended; a text of the language
needs few. The phrases times the bits that name a place in the sample are what the text costs in that language, and the cheapest wins.

A task steps many texts through all automata at once, as arrays.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from seqwatch.llm.common import carried, store

#: Pieces of different labelled texts that all languages together are learnt from, at most, and of one language, and code points of a piece.
PIECES, PIECES_EACH, PIECE = 800, 120, 500
#: Languages that are learnt, at most: those with the most texts.
LANGUAGES = 64
#: Letters with a symbol of their own, and symbols that all others share by their code points.
OWN, SHARED = 96, 32
#: Symbols after which the parse begins anew, in all languages: long texts become this many steps.
RUN = 4096
#: Symbols that are stepped through together.
TOGETHER = 1 << 22
UNKNOWN = "und"
#: Of documents, the quarter with this remainder of their id's CRC-32 teaches nothing.
PARTS, HELD_OUT = 4, 2

_FLAG = np.int32(-(2**31))
_MASK = np.int32(2**31 - 1)


def identify(
    docs: DataFrame, pieces: int = PIECES, pieces_each: int = PIECES_EACH, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learnt from the documents with an id, a language and a text that aren't held out, and from their text and language only: at most ``pieces_each``
    pieces of different texts per language. ``lang_pred`` is the language in which the whole text costs least, of equal ones the
    first by code points; ``und`` if the text is null or has no letter, or if nothing could be learnt. ``score`` is 1 less the ratio of
    the least cost to the next: 0 for ``und`` and ties, 1 if there is one language only. A null id is not held out. Case and what is no letter tell nothing, but
    that words end. Long texts are parsed in runs of ``RUN`` letters and word ends. Repeated ids are rows of their own. An empty table gives
    an empty result. Other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(PARTS)) == HELD_OUT, F.lit(False))
    narrow = narrow.withColumn("held_out", held_out)
    parser = learn(narrow.where("doc_id is not null and not held_out").select("text", "lang"), pieces, pieces_each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = parser.best(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = narrow.select(carried(F.col("doc_id")).alias("doc_id"), "held_out", "text")
    return rows.mapInArrow(run, "doc_id string, held_out boolean, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast(kind))


def learn(labelled: DataFrame, pieces: int = PIECES, pieces_each: int = PIECES_EACH) -> Parser:
    """A parser learnt from rows of text and lang."""
    keyed = labelled.where("text is not null and lang is not null").withColumn("key", F.xxhash64("text"))
    different = store(keyed.select("lang", "key").distinct(), "language-keys")
    most = different.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    known = [row.lang for row in most.select("lang").collect()]
    each = max(1, min(pieces_each, pieces // max(len(known), 1)))
    # No more rows than the bound, so they are broadcast.
    order = Window.partitionBy("lang").orderBy("key")
    chosen = different.where(F.col("lang").isin(known)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= each).drop("place")
    start = F.pmod(F.xxhash64(F.lit(1), "text"), F.greatest(F.length("text") - PIECE, F.lit(0)) + 1) + 1
    found = keyed.join(F.broadcast(chosen), ["lang", "key"])
    found = found.select("lang", "key", F.substring("text", start.cast("int"), F.lit(PIECE)).alias("piece"))
    found = store(found.groupBy("lang", "key").agg(F.min("piece").alias("piece")), "language-pieces")

    letters = found.select(F.explode(F.split(F.lower("piece"), "")).alias("letter")).groupBy("letter").count()
    letters = [row.letter for row in letters.orderBy(F.desc("count"), "letter").limit(OWN + 128).collect()]
    alphabet = Alphabet("".join([x for x in letters if len(x) == 1 and x.isalpha()][:OWN]))

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        codes = np.concatenate([alphabet.codes(piece) for piece in frame.sort_values("key")["piece"]])
        table = suffix_automaton(codes, alphabet.size)
        state, code = np.nonzero(table)
        return pd.DataFrame({
            "lang": [key[0]], "symbols": [len(codes)], "states": [len(table)], "state": [state.astype(np.int32).tobytes()],
            "code": [code.astype(np.uint8).tobytes()], "target": [table[state, code].tobytes()],
        })

    schema = "lang string, symbols int, states int, state binary, code binary, target binary"
    automata = sorted(found.groupBy("lang").applyInPandas(build, schema).collect(), key=lambda row: row.lang)
    return Parser(
        alphabet, [row.lang for row in automata], [row.symbols for row in automata],
        [Automaton(row.states, bytes(row.state), bytes(row.code), bytes(row.target)) for row in automata],
    )


@dataclass(frozen=True)
class Alphabet:
    """Symbols of letters: 0 is for what is no letter, then one for each of ``letters``, then those that all others share."""

    letters: str

    @property
    def size(self) -> int:
        return 1 + len(self.letters) + SHARED

    def codes(self, text: str) -> np.ndarray:
        """The text's symbols, in lower case, with one 0 before, between and after its words."""
        table = _symbols(self.letters)
        found = table[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]
        found = np.concatenate([[np.uint8(0)], found, [np.uint8(0)]])
        return found[np.concatenate([[True], (found[1:] != 0) | (found[:-1] != 0)])]


_TABLES: dict[object, np.ndarray] = {}


def _symbols(letters: str) -> np.ndarray:
    """For each code point its symbol; made once in a process."""
    if ("symbols", letters) not in _TABLES:
        every = np.arange(0x110000, dtype=np.uint64)
        # Surrogates are no text; a table of them costs nothing.
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        shared = 1 + len(letters) + ((every * np.uint64(2654435761) >> np.uint64(13)) % np.uint64(SHARED))
        table = np.where(letter, shared, 0).astype(np.uint8)
        table[[ord(x) for x in letters]] = np.arange(1, len(letters) + 1)
        _TABLES["symbols", letters] = table
    return _TABLES["symbols", letters]


@dataclass(frozen=True)
class Automaton:
    """The transitions of a suffix automaton, as packed arrays."""

    states: int
    state: bytes
    code: bytes
    target: bytes


def suffix_automaton(codes: np.ndarray, size: int) -> np.ndarray:
    """For each state and symbol the next state, 0 for none. State 0 is the start, to which nothing leads; from it exactly the substrings can be read."""
    codes = codes.tolist()
    following = array("i", bytes(4 * size * (2 * len(codes) + 1)))
    link, length, last, states = [-1], [0], 0, 1
    for code in codes:
        made, states = states, states + 1
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and not following[at * size + code]:
            following[at * size + code] = made
            at = link[at]
        if at >= 0:
            met = following[at * size + code]
            if length[at] + 1 == length[met]:
                link[made] = met
            else:
                # The substrings that end here and those that don't part.
                copy, states = states, states + 1
                length.append(length[at] + 1)
                link.append(link[met])
                following[copy * size : (copy + 1) * size] = following[met * size : (met + 1) * size]
                while at >= 0 and following[at * size + code] == met:
                    following[at * size + code] = copy
                    at = link[at]
                link[met] = link[made] = copy
        last = made
    return np.frombuffer(following, np.int32)[: states * size].reshape(states, size)


@dataclass
class Parser:
    """The automata of all languages."""

    alphabet: Alphabet
    languages: list[str]
    symbols: list[int]
    automata: list[Automaton]

    def _steps(self) -> tuple[np.ndarray, np.ndarray]:
        """One table for all languages: from a state and a symbol the state after it, flagged if a new phrase begins with the symbol; and the starts."""
        digest = hashlib.sha256(repr(self.alphabet).encode() + b"".join(a.state + a.code + a.target for a in self.automata)).digest()
        if ("steps", digest) not in _TABLES:
            for old in [key for key in _TABLES if key[0] == "steps"]:
                del _TABLES[old]
            size = self.alphabet.size
            starts = np.concatenate([[0], np.cumsum([a.states for a in self.automata])[:-1]]).astype(np.int64) * size
            table = np.empty((sum(a.states for a in self.automata), size), np.int32)
            for start, one in zip(starts, self.automata, strict=True):
                first = start // size
                state, code, target = np.frombuffer(one.state, np.int32), np.frombuffer(one.code, np.uint8), np.frombuffer(one.target, np.int32)
                # Where no match goes on, one begins with the symbol, or, if the language hasn't got it, after it.
                afresh = np.full(size, start, np.int32)
                from_start = state == 0
                afresh[code[from_start]] = start + target[from_start] * size
                table[first : first + one.states] = afresh | _FLAG
                going = ~from_start
                table[first + state[going], code[going]] = start + target[going] * size
            _TABLES["steps", digest] = table.reshape(-1), starts.astype(np.int32)
        return _TABLES["steps", digest]

    def best(self, texts) -> tuple[list[str], np.ndarray]:
        """For each of the texts (an Arrow array) its language and score."""
        phrases = np.zeros((len(self.languages), len(texts)), np.int64)
        has_letters = np.zeros(len(texts), bool)
        runs: list[tuple[int, np.ndarray]] = []
        held = 0
        if self.languages:
            for i, text in enumerate(texts):
                codes = self.alphabet.codes(text.as_py()) if text.is_valid else np.empty(0, np.uint8)
                has_letters[i] = codes.any()
                if not has_letters[i]:
                    continue
                for at in range(0, len(codes), RUN):
                    runs.append((i, codes[at : at + RUN]))
                    held += len(runs[-1][1])
                    if held >= TOGETHER:
                        self._parse(runs, phrases)
                        runs, held = [], 0
        self._parse(runs, phrases)
        # In bits, but for the text's own length, which is the same for all languages.
        costs = phrases * np.log2(np.maximum(np.array(self.symbols), 2.0))[:, None]
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        least = costs.argmin(axis=0)
        ordered = np.sort(costs, axis=0)
        score = 1 - ordered[0] / np.maximum(ordered[1], 1e-300) if len(costs) > 1 else np.ones(len(texts))
        found = [self.languages[k] if known else UNKNOWN for k, known in zip(least, has_letters, strict=True)]
        return found, np.where(has_letters, np.clip(score, 0.0, 1.0), 0.0)

    def _parse(self, runs: list[tuple[int, np.ndarray]], phrases: np.ndarray) -> None:
        """Add to ``phrases`` those of the runs, by text and language."""
        if not runs:
            return
        table, starts = self._steps()
        runs = sorted(runs, key=lambda run: -len(run[1]))
        lengths = np.array([len(codes) for _, codes in runs])
        # A row per step; the runs that have ended are to the right.
        grid = np.zeros((lengths[0], len(runs)), np.uint8)
        for k, (_, codes) in enumerate(runs):
            grid[: len(codes), k] = codes
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        state = np.repeat(starts[:, None], len(runs), axis=1)
        count = np.zeros(state.shape, np.int32)
        for step, n in enumerate(active.tolist()):
            reached = table.take(state[:, :n] + grid[step, :n])
            count[:, :n] -= reached >> 31
            state[:, :n] = reached & _MASK
        text = np.array([i for i, _ in runs])
        for k in range(len(starts)):
            phrases[k] += np.bincount(text, count[k], phrases.shape[1]).astype(np.int64)
