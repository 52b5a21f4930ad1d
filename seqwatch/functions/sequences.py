"""Expressions on nucleotide sequences and on the text of fetched documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

# Header phrases per serotype (any one is enough; the first serotype has no bare form),
# the completeness phrases (any one is required), and the phrase that excludes. All case-sensitive.
SEROTYPE_PHRASES: dict[str, tuple[str, ...]] = {
    "DENV1": ("Dengue virus type 1", "Dengue virus 1", "DENV-1", "Orthoflavivirus denguei"),
    "DENV2": ("Dengue virus type 2", "Dengue virus 2", "DENV-2", "DENV2", "Orthoflavivirus denguei"),
    "DENV3": ("Dengue virus type 3", "Dengue virus 3", "DENV-3", "DENV3", "Orthoflavivirus denguei"),
    "DENV4": ("Dengue virus type 4", "Dengue virus 4", "DENV-4", "DENV4", "Orthoflavivirus denguei"),
}
COMPLETE_PHRASES = ("complete genome", "complete cds")
PARTIAL_PHRASE = "partial"

# Fixed value: the letters of the DNA alphabet, upper case (bases, ambiguity codes, gap marks).
DNA_ALPHABET = "ACGTMRWSYKVHDBN-+."
_DNA_LETTERS = DNA_ALPHABET.replace("-", "")

# Fixed value: white space, as \s has it.
BLANKS = (" ", "\t", "\r", "\n", "\x0b", "\f")

# Line widths of the two kinds of FASTA output.
PURGED_WIDTH = 80
FILTERED_WIDTH = 60

Rules = Mapping[str, Sequence[str]]


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    """True when the text holds one of the phrases.

    The phrases are plain text, so this is a byte search in generated code: no regular expression
    engine and no decoding of a whole genome per rule.
    """
    first, *others = phrases
    found = text.contains(first)
    for phrase in others:
        found = found | text.contains(phrase)
    return found


def is_complete(text: Column) -> Column:
    """Named complete and nowhere named partial."""
    return contains_any(text, COMPLETE_PHRASES) & ~text.contains(PARTIAL_PHRASE)


def matches_rule(text: Column, phrases: Sequence[str]) -> Column:
    """The serotype rule on a whole document, header and body."""
    return is_complete(text) & contains_any(text, phrases)


def serotype_flags(text: Column, rules: Rules = SEROTYPE_PHRASES) -> dict[str, Column]:
    """One flag column per rule, named ``is_<label>``. One document may meet several rules."""
    return {f"is_{label}": matches_rule(text, phrases) for label, phrases in rules.items()}


def met_rules(rules: Rules = SEROTYPE_PHRASES) -> Column:
    """Array of the labels whose flag column is true, with NULL in the other places."""
    return F.array(*[F.when(F.col(f"is_{label}"), F.lit(label)) for label in rules])


def count_met(rules: Rules = SEROTYPE_PHRASES) -> Column:
    """How many of the flag columns are true."""
    flags = [F.coalesce(F.col(f"is_{label}"), F.lit(False)).cast("int") for label in rules]
    return reduce(add, flags)


def outcome(body: Column, accepted: Column) -> Column:
    """What became of a document: no body is an error, otherwise the rule decides."""
    return F.when(body.isNull(), "errors").when(accepted, "included").otherwise("excluded")


def has_gap_or_undetermined(sequence: Column) -> Column:
    """A gap or an N of either case anywhere in the sequence. Other ambiguity codes are no reason."""
    return contains_any(sequence, ("-", "N", "n"))


def without_blanks(text: Column) -> Column:
    """The text without white space. Most sequences hold none, so that is looked at first."""
    return F.when(contains_any(text, BLANKS), F.regexp_replace(text, r"\s+", "")).otherwise(text)


def non_dna_count(sequence: Column) -> Column:
    """Number of characters outside the DNA alphabet; clean runs are removed in one step each."""
    return F.length(F.regexp_replace(sequence, f"[{_DNA_LETTERS}{_DNA_LETTERS.lower()}-]+", ""))


def as_dna(sequence: Column) -> Column:
    """Upper case, with the characters outside the DNA alphabet left out, as a DNA reader yields it."""
    upper = F.upper(sequence)
    return F.when(non_dna_count(sequence) > 0, F.regexp_replace(upper, f"[^{_DNA_LETTERS}-]+", "")).otherwise(upper)


def ambiguous_count(sequence: Column) -> Column:
    """Number of characters other than A, C, G, T of either case.

    Clean runs are removed in one step each, so a good sequence costs a single pass.
    """
    return F.length(F.regexp_replace(sequence, "[ACGTacgt]+", ""))


def ambiguous_fraction(sequence: Column) -> Column:
    """Share of ambiguous characters; NULL for an empty sequence."""
    return F.try_divide(ambiguous_count(sequence), F.length(sequence))


def wrap(sequence: Column, width: int) -> Column:
    """Line breaks after every ``width`` characters, none at the end."""
    return F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")


def fasta_entry(description: Column, sequence: Column, width: int) -> Column:
    """One FASTA record: the header line, then the wrapped sequence if there is any."""
    header = F.concat(F.lit(">"), description)
    return F.concat_ws("\n", header, F.nullif(wrap(sequence, width), F.lit("")))
