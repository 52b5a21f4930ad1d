"""Filters and counts on FASTA records and fetched documents. The filters are map-only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from seqwatch.functions.sequences import (
    SEROTYPE_PHRASES,
    Rules,
    ambiguous_count,
    ambiguous_fraction,
    as_dna,
    count_met,
    has_gap_or_undetermined,
    matches_rule,
    met_rules,
    non_dna_count,
    outcome,
    serotype_flags,
)


def with_ambiguity(records: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Add the number and the share of ambiguous characters."""
    return records.withColumns(
        {"n_ambiguous": ambiguous_count(F.col(sequence)), "ambiguous_fraction": ambiguous_fraction(F.col(sequence))}
    )


def filter_ambiguous(records: DataFrame, max_ambiguous: float = 0.0, sequence: str = "sequence") -> DataFrame:
    """Records whose share of ambiguous characters is at most the limit. Empty sequences have no share."""
    return records.where(ambiguous_fraction(F.col(sequence)) <= max_ambiguous)


def ambiguity_counts(max_ambiguous: float = 0.0, sequence: str = "sequence") -> list[Column]:
    """Aggregates over records with their share: how many ``filter_ambiguous`` sees, keeps, drops, and finds empty."""
    kept = F.count_if(F.col("ambiguous_fraction") <= max_ambiguous)
    return [
        F.count(F.lit(1)).alias("total"),
        kept.alias("kept"),
        (F.count(F.lit(1)) - kept).alias("dropped"),
        F.count_if(F.col(sequence) == "").alias("n_empty"),
    ]


def ambiguity_stats(records: DataFrame, max_ambiguous: float = 0.0, sequence: str = "sequence") -> DataFrame:
    return with_ambiguity(records, sequence).agg(*ambiguity_counts(max_ambiguous, sequence))


def to_dna(records: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Sequences as a DNA reader gives them, with the number of characters it leaves out."""
    return records.withColumns({"n_non_dna": non_dna_count(F.col(sequence)), sequence: as_dna(F.col(sequence))})


def _sound(sequence: str) -> Column:
    # A missing sequence is not a sound one; the test itself would give NULL.
    return F.coalesce(~has_gap_or_undetermined(F.col(sequence)), F.lit(False))


def with_soundness(records: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Mark the records without a gap or an undetermined base as ``sound``."""
    return records.withColumn("sound", _sound(sequence))


def purge(records: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Drop the records that hold a gap or an undetermined base."""
    return records.where(_sound(sequence))


def purge_counts() -> list[Column]:
    """Aggregates over marked records: how many ``purge`` sees, keeps and removes."""
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if("sound").alias("valid"),
        (F.count(F.lit(1)) - F.count_if("sound")).alias("removed"),
    ]


def purge_stats(records: DataFrame, sequence: str = "sequence") -> DataFrame:
    return with_soundness(records, sequence).select("sound").agg(*purge_counts())


def keep_serotype(documents: DataFrame, label: str, rules: Rules = SEROTYPE_PHRASES, text: str = "body") -> DataFrame:
    """The documents that meet one serotype's rule."""
    return documents.where(matches_rule(F.col(text), rules[label])).withColumn("serotype", F.lit(label))


def match_serotypes(documents: DataFrame, rules: Rules = SEROTYPE_PHRASES, text: str = "body") -> DataFrame:
    """One row per document and serotype whose rule it meets, and how many it meets.

    The rules are expressions on the row, so all serotypes take one pass and no join. A document that
    meets none has nothing to explode; a filter would make Spark test the rules a second time.
    """
    flagged = documents.withColumns(serotype_flags(F.col(text), rules))
    counted = flagged.withColumn("n_serotypes", count_met(rules))
    labels = F.when(F.col("n_serotypes") > 0, met_rules(rules))
    labelled = counted.select(*documents.columns, "n_serotypes", F.explode(labels).alias("serotype"))
    return labelled.where(F.col("serotype").isNotNull())


def classify(documents: DataFrame, label: str, rules: Rules = SEROTYPE_PHRASES, text: str = "body") -> DataFrame:
    """Each document's outcome under one serotype's rule: included, excluded or errors."""
    return documents.withColumn("outcome", outcome(F.col(text), matches_rule(F.col(text), rules[label])))


def union_collections(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One collection out of several, columns matched by name."""
    return reduce(DataFrame.unionByName, others, first)
