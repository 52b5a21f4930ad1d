"""Sequence collections: from landed responses to purged FASTA."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from seqwatch.functions.sequences import FILTERED_WIDTH, PURGED_WIDTH, SEROTYPE_PHRASES, Rules, count_met, met_rules, serotype_flags
from seqwatch.operators.fetches import MAX_ATTEMPTS, first_success, pages_before_cutoff
from seqwatch.operators.sequences import (
    ambiguity_counts,
    purge,
    purge_counts,
    purge_stats,
    to_dna,
    with_ambiguity,
    with_soundness,
)
from seqwatch.session import ensure_checkpoint_dir
from seqwatch.sinks.fasta import write_fasta
from seqwatch.sinks.tables import write_kept
from seqwatch.sources.fasta import FASTA_GLOB, read_fasta, read_fasta_folder, records_of_documents
from seqwatch.sources.remote import land_documents, land_search
from seqwatch.sources.search import listed_pages


class Collection(NamedTuple):
    """What is kept, and the counts of a run. Both are lazy."""

    kept: DataFrame
    stats: DataFrame


def curate(
    fetch_log: DataFrame,
    rules: Rules = SEROTYPE_PHRASES,
    listings: DataFrame | None = None,
    max_attempts: int = MAX_ATTEMPTS,
) -> Collection:
    """Judge the documents of a fetch log under every serotype's rule at once.

    ``fetch_log`` has ``id``, ``attempt``, ``status`` and ``body``. ``kept`` has one row per id and
    serotype; ``stats`` counts included, excluded and failed ids per serotype. With ``listings`` (rows
    with an ``id``, as a search lists them) only listed ids count, once per listing; an id that was
    never fetched is an error.

    The rules are tested before the shuffle on ``id``: bodies no rule accepts stay where they are, and
    ``stats`` moves flags only.
    """
    judged, per_id = _judged(fetch_log, rules), _per_id(listings)

    documents = first_success(_slim(judged, rules), ["body", *_flags(rules)], max_attempts=max_attempts)
    if per_id is not None:
        documents = documents.join(per_id, "id", "left_semi")

    flags = first_success(judged, ["has_body", *_flags(rules)], max_attempts=max_attempts)
    totals = _seen(flags, per_id).agg(*_totals(rules))
    return Collection(_labelled(documents, rules), _per_serotype(totals, rules))


def curate_search(
    responses: DataFrame,
    fetch_log: DataFrame,
    rules: Rules = SEROTYPE_PHRASES,
    max_attempts: int = MAX_ATTEMPTS,
) -> Collection:
    """``curate`` for the ids of a landed search: pages (``retstart``, ``body``) up to the first empty one."""
    return curate(fetch_log, rules, search_listings(responses), max_attempts)


def fetch_and_curate(
    spark: SparkSession,
    folder: str,
    rules: Rules = SEROTYPE_PHRASES,
    max_attempts: int = MAX_ATTEMPTS,
    tasks: int | None = None,
    pages_per_task: int = 1,
    **options: object,
) -> Collection:
    """Search, fetch and ``curate``: pages up to the first empty one, then their documents, with tries side by side in tasks.

    ``options`` say how requests are answered: ``transport`` and its own settings, ``pause``. Pages and documents are landed below ``folder``;
    a run over a folder where some have landed asks for the others only.
    """
    place = folder.rstrip("/")
    asked = {"max_attempts": max_attempts, **options}
    pages = land_search(spark, f"{place}/pages", pages_per_task=pages_per_task, **asked)
    listings = search_listings(pages.select("retstart", "body"))
    log = land_documents(listings, f"{place}/documents", tasks, **asked)
    return curate(log, rules, listings, max_attempts)


def search_listings(responses: DataFrame) -> DataFrame:
    """The ids that a landed search lists up to its first empty page, each as often as it is listed.

    Where a search ends and what it lists are both taken from the parsed pages. These are kept at a checkpoint when the
    function is called, so that the responses are read and parsed once.
    """
    ensure_checkpoint_dir(responses.sparkSession)
    pages = listed_pages(responses).checkpoint().withColumn("n_ids", F.coalesce(F.array_size("ids"), F.lit(0)))
    return pages_before_cutoff(pages).select("retstart", F.explode("ids").alias("id"))


def curate_search_to_folder(
    responses: DataFrame,
    fetch_log: DataFrame,
    path: str,
    rules: Rules = SEROTYPE_PHRASES,
    max_attempts: int = MAX_ATTEMPTS,
) -> DataFrame:
    """``curate_to_folder`` for the ids of a landed search."""
    return curate_to_folder(fetch_log, path, rules, search_listings(responses), max_attempts)


def curate_to_folder(
    fetch_log: DataFrame,
    path: str,
    rules: Rules = SEROTYPE_PHRASES,
    listings: DataFrame | None = None,
    max_attempts: int = MAX_ATTEMPTS,
) -> DataFrame:
    """``curate``, with the kept documents written by serotype; returns the counts, taken on the way to the files.

    The log is read for its winning tries, without the bodies, and once with them.
    """
    judged = _judged(fetch_log, rules)
    fetched = first_success(_slim(judged, rules), ["body", "has_body", *_flags(rules)], max_attempts=max_attempts)
    seen = _seen(fetched, _per_id(listings))
    counts = Observation()
    write_kept(_labelled(seen.observe(counts, *_totals(rules)), rules), path)
    return _per_serotype(_observed(fetch_log.sparkSession, counts), rules)


def purge_records(records: DataFrame) -> Collection:
    """DNA records without gaps and undetermined bases, and how many there were.

    Reading a sequence as DNA neither adds nor removes gaps and undetermined bases, so only what
    stays is read.
    """
    return Collection(to_dna(purge(records)), purge_stats(records))


def purge_by_serotype(
    kept: DataFrame, path: str, rules: Rules = SEROTYPE_PHRASES, width: int = PURGED_WIDTH, text: str = "body"
) -> DataFrame:
    """Purge kept documents (``serotype``, ``body``) and write them as FASTA, one folder per serotype; returns the counts per serotype.

    All serotypes in one pass, without a shuffle: documents are cut into records, marked, counted and
    written where they are read. Serotypes that are not in ``rules`` are written but not counted.
    """
    counts = Observation()
    marked = with_soundness(records_of_documents(kept, text))
    wanted = []
    for label in rules:
        of_label = F.col("serotype") == label
        wanted += [F.count_if(of_label).alias(f"total_{label}"), F.count_if(of_label & F.col("sound")).alias(f"valid_{label}")]
    records = to_dna(marked.observe(counts, *wanted).where("sound"))
    write_fasta(records, path, width, partition_by=["serotype"])
    totals = _observed(kept.sparkSession, counts)
    rows = [
        F.struct(
            F.lit(label).alias("serotype"),
            F.col(f"total_{label}").alias("total"),
            F.col(f"valid_{label}").alias("valid"),
            (F.col(f"total_{label}") - F.col(f"valid_{label}")).alias("removed"),
        )
        for label in rules
    ]
    return totals.select(F.inline(F.array(*rows)))


def purge_folder(
    spark: SparkSession,
    folder: str,
    output: str,
    width: int = PURGED_WIDTH,
    glob: str = FASTA_GLOB,
    whole_files: bool = False,
) -> DataFrame:
    """Purge the FASTA files of a folder into ``output``; returns the counts. No shuffle.

    Each part file holds the records of the blocks its task read. Where the order of the whole set
    matters, write ``purge_records(...).kept`` with ``order_by=FILE_ORDER``.
    """
    counts = Observation()
    marked = with_soundness(read_fasta_folder(spark, folder, glob, whole_files))
    write_fasta(to_dna(marked.observe(counts, *purge_counts()).where("sound")), output, width)
    return _observed(spark, counts)


def filter_fasta(
    spark: SparkSession,
    path: str,
    output: str,
    max_ambiguous: float = 0.0,
    width: int = FILTERED_WIDTH,
    glob: str | None = None,
    whole_files: bool = False,
) -> DataFrame:
    """Keep the records with few enough ambiguous characters; returns the counts. No shuffle."""
    counts = Observation()
    found = read_fasta(spark, path, glob, whole_files)
    records = with_ambiguity(found).observe(counts, *ambiguity_counts(max_ambiguous))
    write_fasta(records.where(F.col("ambiguous_fraction") <= max_ambiguous), output, width)
    return _observed(spark, counts)


def _observed(spark: SparkSession, counts: Observation) -> DataFrame:
    """The counts of a finished write as a table of one row.

    They are taken in the tasks that write, so Spark adds each task once, retried or not.
    """
    found = counts.get
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{name} bigint" for name in found))


def _flags(rules: Rules) -> list[str]:
    return [f"is_{label}" for label in rules]


def _judged(fetch_log: DataFrame, rules: Rules) -> DataFrame:
    flags = serotype_flags(F.col("body"), rules)
    return fetch_log.withColumns({**flags, "has_body": F.col("body").isNotNull()})


def _slim(judged: DataFrame, rules: Rules) -> DataFrame:
    """Without the bodies that no rule accepts. Which success is the first does not depend on them."""
    return judged.withColumn("body", F.when(count_met(rules) > 0, F.col("body")))


def _per_id(listings: DataFrame | None) -> DataFrame | None:
    return None if listings is None else listings.groupBy("id").agg(F.count(F.lit(1)).alias("n_listed"))


def _seen(fetched: DataFrame, per_id: DataFrame | None) -> DataFrame:
    """The ids that count, and how often."""
    if per_id is None:
        return fetched.withColumn("n_listed", F.lit(1).cast("long"))
    return per_id.join(fetched, "id", "left")


def _labelled(fetched: DataFrame, rules: Rules) -> DataFrame:
    accepted = fetched.where("body is not null")
    return accepted.select("id", F.explode(met_rules(rules)).alias("serotype"), "body").where("serotype is not null")


def _totals(rules: Rules) -> list[Column]:
    """Listings without a body, with one, and accepted per serotype."""

    def listed(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n_listed"))), F.lit(0).cast("long"))

    has_body = F.coalesce(F.col("has_body"), F.lit(False))
    return [
        listed(~has_body).alias("errors"),
        listed(has_body).alias("bodies"),
        *[listed(F.col(f"is_{label}")).alias(f"n_{label}") for label in rules],
    ]


def _per_serotype(totals: DataFrame, rules: Rules) -> DataFrame:
    rows = [
        F.struct(
            F.lit(label).alias("serotype"),
            F.col(f"n_{label}").alias("included"),
            (F.col("bodies") - F.col(f"n_{label}")).alias("excluded"),
            F.col("errors"),
        )
        for label in rules
    ]
    return totals.select(F.inline(F.array(*rows)))
