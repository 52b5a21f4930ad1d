"""Rules that are rows of a table: thousands of phrases looked for in one pass over each text.

A rule is a label with clauses. A clause is a pattern, phrases between bars, of which one has to be in the text; a negated clause must have
none in it. Clauses of one pattern are looked for once, and a rule is looked at only in texts that meet its rarest clause.

The phrases of a small table make one automaton. A larger table is dealt into parts, each in arrays of bounded size: texts are gone through once for what
a bitmap of fixed size takes for a phrase, and what was found is looked up in each part where the text is. Texts and rules that meet are many more than
either, so they are made last and never stored or moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from seqwatch.functions.sequences import COMPLETE_PHRASES, PARTIAL_PHRASE, SEROTYPE_PHRASES, Rules
from seqwatch.session import scratch_path, ship_package

#: Letters of the patterns of one automaton, at most. Tables with more are made into arrays; ``compile_rules`` deals them over several.
MOST_LETTERS = 2_000_000
#: Bytes of one part of a larger table, about; a process holds one part. The driver makes it of twice as many bytes of rules.
PART_BYTES = 1 << 26
#: Labels that a row, and a batch of rows, gives on at once.
PIECE, BATCH = 1 << 12, 1 << 17
#: With so many sets of other clauses, or fewer, all are tested before the rules are looked at, and first of all if they have as few phrases.
FEW_KINDS = 256
#: Bits of the bitmap of the phrases, at least and at most: two to these powers. With more phrases it tells less, and more is moved; results do not depend on it.
FEWEST_BITS, MOST_BITS = 20, 28
#: Code points that are gone through at once. A longer text is one go.
AT_ONCE = 1 << 20
RULES = "label string, pattern string, negated boolean"


@dataclass(frozen=True)
class Clauses:
    """Rules made ready: for each phrase the patterns it meets, for each pattern the rules that it leads, for each rule the patterns that must and must not be met."""

    labels: tuple[str, ...]
    needed: tuple[frozenset[int], ...]
    negated: tuple[frozenset[int], ...]
    led: dict[int, tuple[int, ...]]
    phrases: tuple[tuple[str, tuple[int, ...]], ...]
    digest: str

    def automaton(self) -> ahocorasick.Automaton:
        """Built once in a process."""
        if self.digest not in _AUTOMATA:
            if len(_AUTOMATA) > 8:
                _AUTOMATA.clear()
            made = ahocorasick.Automaton()
            for phrase, patterns in self.phrases:
                made.add_word(phrase, patterns)
            made.make_automaton()
            _AUTOMATA[self.digest] = made
        return _AUTOMATA[self.digest]

    def met(self, text: str | None) -> list[str] | None:
        """The labels of the rules that a text meets."""
        if text is None:
            return None
        found: set[int] = set()
        for patterns in {id(p): p for _, p in self.automaton().iter(text)}.values():
            found.update(patterns)
        rules = [rule for pattern in found for rule in self.led.get(pattern, ())]
        return sorted(self.labels[rule] for rule in rules if self.needed[rule] <= found and self.negated[rule].isdisjoint(found))


_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def rules_table(spark: SparkSession, rules: Rules = SEROTYPE_PHRASES) -> DataFrame:
    """The serotype rules as a table."""
    rows = []
    for label, phrases in rules.items():
        rows += [(label, "|".join(phrases), False), (label, "|".join(COMPLETE_PHRASES), False), (label, PARTIAL_PHRASE, True)]
    return spark.createDataFrame(rows, RULES)


def match_rules(documents: DataFrame, rules: DataFrame, text: str = "body", label: str = "serotype") -> DataFrame:
    """One row per document and rule it meets, with the rule's ``label`` and how many the document meets, as ``n_<label>s``.

    ``rules`` has label, pattern and negated (optional). Patterns are phrases between bars, plain and case-sensitive: characters that stand for others in a
    regular expression are refused, not misread. Empty phrases, and rows without a label or phrases, are left out; a rule with negated clauses only is
    refused. A document without text meets none.
    """
    ship_package(documents.sparkSession)
    rules = _stored(_cleaned(rules), "rules")
    number = f"n_{label}s"
    if (rules.agg(F.sum(F.length("pattern"))).first()[0] or 0) <= MOST_LETTERS:
        met = [_met_by(part)(F.col(text)) for part in compile_rules(rules)]
        found = documents.withColumn("_met", F.concat(*met) if met else F.array().cast("array<string>")).withColumn(number, F.size("_met"))
    else:
        found = _met_by_parts(documents, rules, text, number)
    return found.select(*documents.columns, number, F.explode("_met").alias(label))


def _met_by(clauses: Clauses):
    @F.pandas_udf("array<string>")
    def met(texts: pd.Series) -> pd.Series:
        return pd.Series([clauses.met(text) for text in texts], dtype=object)

    return met


def compile_rules(rules: DataFrame, most_letters: int = MOST_LETTERS) -> list[Clauses]:
    """The rules in parts of bounded size. A table of rules is read by the driver part by part, never as a whole."""
    rows = _cleaned(rules)
    parts: list[Clauses] = []
    held: list[tuple[str, str, bool]] = []
    letters = 0
    # In the order of labels, so that a rule is in one part.
    for row in rows.orderBy("label", "negated", "pattern").toLocalIterator():
        if held and held[-1][0] != row.label and letters >= most_letters:
            parts.append(_compiled(held))
            held, letters = [], 0
        held.append((row.label, row.pattern, row.negated))
        letters += len(row.pattern)
    if held:
        parts.append(_compiled(held))
    return [part for part in parts if part.labels]


def _cleaned(rules: DataFrame) -> DataFrame:
    negated = F.coalesce("negated", F.lit(False)) if "negated" in rules.columns else F.lit(False)
    return rules.select("label", "pattern", negated.alias("negated")).where("label is not null and pattern is not null").distinct()


_MEANT_OTHERWISE = set("\\^$.*+?()[]{}")


def _refuse_other_characters(label: str, pattern: str) -> None:
    special = _MEANT_OTHERWISE & set(pattern)
    if special:
        raise ValueError(f"rule {label!r}: {''.join(sorted(special))!r} in a pattern is not supported, phrases between bars are")


def _refuse_without_needed(label: str) -> None:
    raise ValueError(f"rule {label!r} has nothing that must be in a text")


def _compiled(rows: Sequence[tuple[str, str, bool]]) -> Clauses:
    patterns: dict[str, int] = {}
    of_phrase: dict[str, list[int]] = {}
    sides: dict[str, tuple[set[int], set[int]]] = {}
    for label, pattern, negated in rows:
        _refuse_other_characters(label, pattern)
        phrases = {phrase for phrase in pattern.split("|") if phrase}
        if not phrases:
            continue
        if pattern not in patterns:
            patterns[pattern] = len(patterns)
            for phrase in phrases:
                of_phrase.setdefault(phrase, []).append(patterns[pattern])
        sides.setdefault(label, (set(), set()))[bool(negated)].add(patterns[pattern])
    rules_of = [0] * len(patterns)
    for label, (needed, _) in sides.items():
        if not needed:
            _refuse_without_needed(label)
        for pattern in needed:
            rules_of[pattern] += 1
    led: dict[int, list[int]] = {}
    for rule, (needed, _) in enumerate(sides.values()):
        led.setdefault(min(needed, key=lambda p: (rules_of[p], p)), []).append(rule)
    made = tuple((phrase, tuple(numbers)) for phrase, numbers in of_phrase.items())
    digest = hashlib.sha256(repr(made).encode()).hexdigest()
    needed, negated = ([frozenset(side[k]) for side in sides.values()] for k in (0, 1))
    return Clauses(tuple(sides), tuple(needed), tuple(negated), {pattern: tuple(rules) for pattern, rules in led.items()}, made, digest)


# Large tables


def _stored(frame: DataFrame, name: str, *by: str) -> DataFrame:
    path = scratch_path(frame.sparkSession, name)
    frame.write.partitionBy(*by).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _met_by_parts(documents: DataFrame, rules: DataFrame, text: str, number: str) -> DataFrame:
    """The documents that meet a rule with how many, as ``number``, and the labels, as _met. Documents with many labels have several rows."""
    bits, lengths, gate, parts = _parts(_refused(rules))
    if text not in documents.columns:
        documents, text = documents.withColumn("_text", F.col(text)), "_text"
    fields, at = documents.schema.fields, documents.columns.index(text)
    labels, counted = T.StructField("_met", T.ArrayType(T.StringType())), T.StructField(number, T.IntegerType())
    if len(parts) == 1:
        return documents.mapInArrow(_labelling(parts[0], at, bits, lengths, gate), T.StructType([*fields, counted, labels]))

    # Texts are gone through once for all parts.
    hits, row = T.StructField("_hits", T.ArrayType(T.StringType())), T.StructField("_row", T.LongType())
    scanned = documents.mapInArrow(_scanning(at, bits, lengths, gate), T.StructType([*fields, hits])).withColumn("_row", F.monotonically_increasing_id())
    scanned = _stored(scanned.select(*documents.columns, "_row", "_hits"), "rules-hits")
    schema = T.StructType([*fields, row, hits, T.StructField("_of_part", T.IntegerType()), labels])
    met = reduce(DataFrame.union, [scanned.mapInArrow(_labelling(part, len(fields) + 1), schema) for part in parts])
    counts = [scanned.select("_row", "_hits").mapInArrow(_labelling(part, 1), T.StructType([row, *schema.fields[-3:]])) for part in parts]
    count = reduce(DataFrame.union, counts).groupBy("_row").agg(F.sum(F.size("_met")).cast("int").alias(number))
    # Who does not ask for the number does without this join.
    return met.join(count, "_row", "left")


def _refused(rules: DataFrame) -> DataFrame:
    """The clauses with phrases, if all can be looked for."""
    special = F.regexp_replace("pattern", r"[^\\^$.*+?()\[\]{}]", "") != ""
    for row in rules.where(special).limit(1).collect():
        _refuse_other_characters(row.label, row.pattern)
    clauses = rules.where(F.regexp_replace("pattern", r"\|", "") != "")
    for row in clauses.groupBy("label").agg(F.bool_and("negated").alias("none")).where("none").limit(1).collect():
        _refuse_without_needed(row.label)
    return clauses


def _parts(clauses: DataFrame) -> tuple[Broadcast, list[int], _Gate, list[Broadcast]]:
    """A bitmap with two bits for each phrase and two for its beginning, the phrases' lengths, which texts are gone through, and the parts. The driver
    holds one part at a time."""
    phrase = F.explode(F.split("pattern", r"\|")).alias("phrase")
    about = clauses.select(phrase).agg(F.approx_count_distinct("phrase").alias("n")).first().n
    size = min(MOST_BITS, max(FEWEST_BITS, (64 * about).bit_length()))
    several = _number_of_parts(clauses)
    if several > 1:
        # A rule is in one part.
        clauses = _stored(clauses.withColumn("part", F.pmod(F.xxhash64("label"), F.lit(several)).cast("int")), "rules-parts", "part")
    bits, lengths, gate, parts = np.zeros((1 << size) // 8, dtype=np.uint8), set(), _Gate(frozenset()), []
    for k in range(several):
        rows = (clauses.where(F.col("part") == k) if several > 1 else clauses).select("label", "pattern", "negated").toArrow()
        part, of_part, own = _part(rows, bits)
        lengths |= of_part
        gate = gate.wider(own)
        if of_part or not k:
            parts.append(clauses.sparkSession.sparkContext.broadcast(part))
    return clauses.sparkSession.sparkContext.broadcast(bits), sorted(lengths), gate, parts


def _number_of_parts(clauses: DataFrame) -> int:
    """A part holds a pattern once for all of its rules; with so many rules as parts, each part has it."""
    own = F.octet_length("label") + 8
    patterns = clauses.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum(own).alias("rules")).withColumn("bytes", F.octet_length("pattern") + 24)
    several = [1 << k for k in range(16)]
    held = [F.sum(F.col("bytes") * F.least(F.lit(1.0), F.col("n") / k) + F.col("rules") / k) for k in several]
    rows = F.sum(F.col("bytes") * F.col("n") + F.col("rules"))
    *held, rows = patterns.agg(*held, rows).first()
    return next((k for k, most in zip(several, held, strict=True) if (most or 0) <= PART_BYTES and (rows or 0) / k <= 2 * PART_BYTES), several[-1])


class _Lists:
    """Lists of numbers, one after the other; each has the values of a key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, n: int):
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=n))]).astype(np.int32)
        self.values = values[np.lexsort((values, keys))].astype(np.int32)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the keys, and how many each has."""
        starts, many = self.starts[keys], self.starts[keys + 1] - self.starts[keys]
        before = np.cumsum(many, dtype=np.int64) - many
        return self.values[np.repeat(starts - before, many) + np.arange(many.sum())], many


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """The different numbers, none negative, in order."""
    numbers = np.sort(numbers)
    return numbers[np.concatenate([[True], numbers[1:] != numbers[:-1]])[: len(numbers)]]


@dataclass(frozen=True)
class Part:
    """Rules made ready in arrays: the phrases in the order of their hashes, for each the patterns that lead rules and those that are tested; for each
    pattern the rules that it leads, in the order of labels; for each rule its kind, and for each kind the other clauses: twice the pattern, and one if negated."""

    labels: pa.Array
    phrases: pa.Array
    hashes: np.ndarray
    #: Phrases of one hash, at most.
    alike: int
    n_patterns: int
    leading: _Lists
    tested: _Lists
    led: _Lists
    kind_of: np.ndarray
    kinds: _Lists
    n_kinds: int

    def looked_up(self, phrases: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the list, and the numbers of the phrases that are there."""
        sought, hashes = pa.array(phrases, self.phrases.type), _hashes(phrases)
        first, places, numbers = np.searchsorted(self.hashes, hashes), [], []
        for k in range(self.alike):
            at = np.flatnonzero(first + k < len(self.hashes))
            at = at[self.hashes[first[at] + k] == hashes[at]]
            same = pc.equal(self.phrases.take(pa.array(first[at] + k)), sought.take(pa.array(at))).to_numpy(zero_copy_only=False)
            places.append(at[same])
            numbers.append(first[at[same]] + k)
        return np.concatenate([[], *places]).astype(np.int64), np.concatenate([[], *numbers]).astype(np.int64)

    def met(self, phrases: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The rules that a text with these phrases meets, in the order of labels. ``marks``: false for each pattern."""
        tested = self.tested.of(phrases)[0]
        marks[tested] = True
        try:
            every = np.arange(self.n_kinds) if self.n_kinds <= FEW_KINDS else None
            if every is not None and not (passed := self._passed(every, marks)).any():
                return np.empty(0, dtype=np.int32)
            rules = self.led.of(_distinct(self.leading.of(phrases)[0]))[0]
            kinds = self.kind_of[rules]
            if every is None:
                some, kinds = np.unique(kinds, return_inverse=True)
                passed = self._passed(some, marks)
            return np.sort(rules[passed[kinds]])
        finally:
            marks[tested] = False

    def _passed(self, kinds: np.ndarray, marks: np.ndarray) -> np.ndarray:
        clauses, many = self.kinds.of(kinds)
        against = marks[clauses >> 1] == (clauses & 1)
        return np.bincount(np.repeat(np.arange(len(kinds)), many), weights=against, minlength=len(kinds)) == 0


Phrases = frozenset[str]


@dataclass(frozen=True)
class _Gate:
    """The sets of clauses, needed and negated, that rules have besides the one that leads them. A text that meets none of the sets meets no rule. None: too many."""

    kinds: frozenset[tuple[frozenset[Phrases], frozenset[Phrases]]] | None

    def wider(self, other: _Gate) -> _Gate:
        kinds = None if self.kinds is None or other.kinds is None else self.kinds | other.kinds
        few = kinds is not None and len(kinds) <= FEW_KINDS and len({phrase for kind in kinds for side in kind for clause in side for phrase in clause}) <= FEW_KINDS
        return _Gate(kinds if few else None)

    def opened(self):
        """Whether a text has to be gone through."""
        if self.kinds is None or (frozenset(), frozenset()) in self.kinds:
            return None
        phrases = {phrase for kind in self.kinds for side in kind for clause in side for phrase in clause}

        def lets(text: str) -> bool:
            there = {phrase for phrase in phrases if phrase in text}
            return any(all(not there.isdisjoint(c) for c in needed) and all(there.isdisjoint(c) for c in negated) for needed, negated in self.kinds)

        return lets


def _part(rows: pa.Table, bits: np.ndarray) -> tuple[Part, set[int], _Gate]:
    """Clauses made ready, the lengths of their phrases, which are entered in the bitmap, and their gate."""
    label, pattern = (rows[name].combine_chunks().dictionary_encode() for name in ("label", "pattern"))
    order = pc.sort_indices(label.dictionary).to_numpy()
    rule, pattern_of = np.argsort(order)[label.indices.to_numpy()], pattern.indices.to_numpy().astype(np.int64)
    negated = rows["negated"].to_numpy().astype(bool)
    n_rules, n_patterns = len(order), len(pattern.dictionary)

    lists = pc.split_pattern(pattern.dictionary, "|")
    parent, flat = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    phrase, parent = flat.filter(some).dictionary_encode(), parent[some.to_numpy(zero_copy_only=False)].astype(np.int64)
    hashes = _hashes(phrase.dictionary, bits)
    by_hash = np.argsort(hashes, kind="stable")
    pairs = divmod(_distinct(np.argsort(by_hash)[phrase.indices.to_numpy()] * n_patterns + parent), max(1, n_patterns))
    hashes = hashes[by_hash]

    # The clause that leads a rule is one that fewest rules have.
    of_rules = np.bincount(pattern_of[~negated], minlength=n_patterns)
    needed = np.flatnonzero(~negated)
    needed = needed[np.lexsort((pattern_of[needed], of_rules[pattern_of[needed]], rule[needed]))]
    leads = needed[np.flatnonzero(np.diff(rule[needed], prepend=-1))]
    led = _Lists(pattern_of[leads], rule[leads], n_patterns)

    others = np.ones(len(rule), dtype=bool)
    others[leads] = False
    clauses = _Lists(rule[others], 2 * pattern_of[others] + negated[others], n_rules)
    kinds: dict[bytes, int] = {}
    kind_of = np.array([kinds.setdefault(clauses.values[a:b].tobytes(), len(kinds)) for a, b in zip(clauses.starts[:-1].tolist(), clauses.starts[1:].tolist(), strict=True)], dtype=np.int32)
    held = [np.frombuffer(kind, dtype=np.int32) for kind in kinds]
    own = np.concatenate([np.empty(0, np.int32), *held])

    def of_phrases(patterns: np.ndarray) -> _Lists:
        wanted = np.zeros(n_patterns, dtype=bool)
        wanted[patterns] = True
        return _Lists(*(numbers[wanted[pairs[1]]] for numbers in pairs), len(hashes))

    part = Part(
        label.dictionary.take(pa.array(order)), phrase.dictionary.take(pa.array(by_hash)), hashes, int(max(np.unique(hashes, return_counts=True)[1], default=0)), n_patterns,
        of_phrases(pattern_of[leads]), of_phrases(own >> 1), led, kind_of, _Lists(np.repeat(np.arange(len(held)), [len(kind) for kind in held]).astype(np.int64), own, len(held)), len(held),
    )

    def clauses_of(kind: np.ndarray, side: int) -> frozenset[Phrases]:
        return frozenset(frozenset(pattern.dictionary[p].as_py().split("|")) - {""} for p in (kind[kind & 1 == side] >> 1).tolist())

    gate = _Gate(frozenset((clauses_of(kind, 0), clauses_of(kind, 1)) for kind in held) if len(held) <= FEW_KINDS and len(own) <= FEW_KINDS * 8 else None)
    return part, set(pc.unique(pc.utf8_length(phrase.dictionary)).to_pylist()), gate


def _hashes(phrases: pa.Array | list[str], bits: np.ndarray | None = None) -> np.ndarray:
    """Hashes of phrases, which are entered in a bitmap with their beginnings if there is one."""
    out = np.empty(len(phrases), dtype=np.uint64)
    for begin in range(0, len(phrases), 10_000):
        some = phrases[begin : begin + 10_000]
        codes, starts, ends = _codes(some if isinstance(some, list) else some.to_pylist())
        windows, own = _Windows(codes), out[begin : begin + 10_000]
        for n in np.unique(ends - starts).tolist():
            own[ends - starts == n] = windows.hashes(starts[ends - starts == n], n)
        if bits is not None:
            begins = _begins(ends - starts)
            for hashes in [own, *(windows.hashes(starts[begins == n], n) for n in np.unique(begins).tolist())]:
                at = _distinct(np.concatenate(_bits(hashes, (len(bits) * 8).bit_length() - 1)))
                places, first = np.unique(at >> 3, return_index=True)
                bits[places] |= np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), first)
    return out


def _labelling(part: Broadcast, at: int, bits: Broadcast | None = None, lengths: Sequence[int] = (), gate: _Gate = _Gate(None)):
    """Rows with the number and the labels of the rules that they meet. Column ``at`` has the texts, or what the bitmap took for phrases in them."""
    piece, most, at_once = PIECE, BATCH, AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = part.value
        marks = np.zeros(own.n_patterns, dtype=bool)
        found, lets = _scan(bits.value, lengths) if bits else None, gate.opened()

        def given(batch: pa.RecordBatch, rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
            offsets = np.cumsum([0, *(len(rules) for _, _, rules in rows)]).astype(np.int32)
            labels = own.labels.take(pa.array(np.concatenate([rules for _, _, rules in rows])))
            columns = batch.take(pa.array([row for row, _, _ in rows], pa.int64())).columns
            more = [pa.array([n for _, n, _ in rows], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), labels)]
            return pa.RecordBatch.from_arrays([*columns, *more], [*batch.schema.names, "_n", "_met"])

        for batch in batches:
            rows, held = [], 0
            for places, hits in _found(batch.column(at), found, lets, at_once):
                where, numbers = own.looked_up([phrase for _, phrase in hits])
                text = np.array([text for text, _ in hits], dtype=np.int64)[where]
                by_text = np.argsort(text, kind="stable")
                text, numbers = text[by_text], numbers[by_text]
                texts, first = np.unique(text, return_index=True)
                for k, phrases in zip(texts.tolist(), np.split(numbers, first[1:]), strict=False):
                    rules = own.met(phrases, marks)
                    for start in range(0, len(rules), piece):
                        rows.append((int(places[k]), len(rules), rules[start : start + piece]))
                        held += len(rows[-1][2])
                        if held >= most:
                            yield given(batch, rows)
                            rows, held = [], 0
            if rows:
                yield given(batch, rows)

    return run


def _scanning(at: int, bits: Broadcast, lengths: Sequence[int], gate: _Gate):
    """Rows with what the bitmap takes for phrases in the texts of column ``at``; those with nothing go."""
    at_once = AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, lets = _scan(bits.value, lengths), gate.opened()
        for batch in batches:
            for places, hits in _found(batch.column(at), found, lets, at_once):
                of_text: dict[int, list[str]] = {}
                for k, phrase in hits:
                    of_text.setdefault(k, []).append(phrase)
                if of_text:
                    columns = batch.take(pa.array(places[list(of_text)])).columns
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(of_text.values(), pa.list_(pa.string()))], [*batch.schema.names, "_hits"])

    return run


def _found(column: pa.Array, found, lets, at_once: int) -> Iterator[tuple[np.ndarray, list[tuple[int, str]]]]:
    """Places of rows, some at a time, and what is found in them with the number of its row among these. Without ``found`` the column has it."""
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    column = column.take(pa.array(there))
    if lets:
        let = np.array([lets(text.as_py()) for text in column], dtype=bool)
        there, column = there[let], column.filter(pa.array(let))
    many = (pc.utf8_length(column) if found else pc.multiply(pc.list_value_length(column), 16)).to_numpy(zero_copy_only=False).astype(np.int64)
    groups = np.cumsum(many) // at_once
    for group in np.unique(groups):
        own = np.flatnonzero(groups == group)
        values = column.take(pa.array(own)).to_pylist()
        yield there[own], list(found(values)) if found else [(k, phrase) for k, phrases in enumerate(values) for phrase in phrases]


def _scan(bits: np.ndarray, lengths: Sequence[int]):
    """The different parts of each text that the bitmap takes for phrases."""
    size = (len(bits) * 8).bit_length() - 1
    by_begin: dict[int, list[int]] = {}
    for length in lengths:
        by_begin.setdefault(int(_begins(np.array([length]))[0]), []).append(length)

    def taken(hashes: np.ndarray) -> np.ndarray:
        """Where the bitmap has both bits."""
        first, second = _bits(hashes, size)
        at = np.flatnonzero((bits[first >> 3] >> (first & 7).astype(np.uint8)) & 1)
        second = second[at]
        return at[(bits[second >> 3] >> (second & 7).astype(np.uint8)) & 1 == 1]

    def found(texts: list[str]) -> set[tuple[int, str]]:
        codes, starts, ends = _codes(texts)
        text_of, windows = np.repeat(np.arange(len(texts)), ends - starts), _Windows(codes)
        left = ends[text_of] - np.arange(len(codes))
        out = set()
        for begin, several in by_begin.items():
            places = np.flatnonzero(left >= begin)
            places = places[taken(windows.hashes(places, begin))]
            for length in several:
                at = places[left[places] >= length]
                if length != begin:
                    at = at[taken(windows.hashes(at, length))]
                for number, first in zip(text_of[at].tolist(), (at - starts[text_of[at]]).tolist(), strict=True):
                    out.add((number, texts[number][first : first + length]))
        return out

    return found


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of the texts one after the other, and where each text starts and ends."""
    ends = np.cumsum([len(text) for text in texts], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts, ends


def _begins(lengths: np.ndarray) -> np.ndarray:
    """The largest power of two that is no longer, so that there are few lengths of beginnings."""
    return 1 << np.floor(np.log2(lengths)).astype(np.int64)


class _Windows:
    """Hashes of parts of a sequence of code points, all parts of a length at a time."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        powers = np.cumprod(np.full(n, self.BASE, dtype=np.uint64))
        # Odd numbers have an inverse, which takes a part's place out of its sum.
        self.unshift = np.cumprod(np.full(n, pow(self.BASE, -1, 1 << 64), dtype=np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * powers)])

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        return _mixed((self.sums[at + length] - self.sums[at]) * self.unshift[at] + np.uint64(length))


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _bits(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """Two bits of a bitmap of two to the power of ``size``."""
    mask = np.uint64((1 << size) - 1)
    return [((hashes >> np.uint64(shift)) & mask).astype(np.int64) for shift in (0, 32)]
