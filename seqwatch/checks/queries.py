"""The registered queries: each runs library operators over whole stand-in tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqwatch.checks import standins
from seqwatch.functions.sequences import PURGED_WIDTH, SEROTYPE_PHRASES
from seqwatch.operators import cases as case_ops
from seqwatch.operators import fetches, geometry, names, order, profile, regions as region_ops, rules, sequences, sketches
from seqwatch.plans import curation, maps, surveillance
from seqwatch.session import scratch_path
from seqwatch.sinks import fasta as fasta_sink
from seqwatch.sinks.tables import write_region_years
from seqwatch.sources.cases import read_cases, read_cases_by_header
from seqwatch.sources.fasta import read_fasta, read_fasta_entries, read_fasta_folder, records_of_documents
from seqwatch.sources.regions import read_regions
from seqwatch.sources.remote import land_documents
from seqwatch.sources.search import count_ids, explode_ids
from seqwatch.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]

# Years of the order dates, with empty years at the end.
YEARS = (1994, 2002)
ONE_YEAR = 1996


# Cases and regions


def annual_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_ops.annual_cases(standins.cases(spark, sf_dir), "ano")


def cases_by_sex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_ops.cases_by_sex(standins.cases(spark, sf_dir), "ano", "sexo")


def cases_by_age_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_ops.cases_by_age_group(standins.cases(spark, sf_dir), "ano", "edad")


def case_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tables of the job in one: they share one pass over the cases."""
    return _one_table(surveillance.case_tables(standins.cases(spark, sf_dir), "ano", "sexo", "edad"))


def _one_table(tables: surveillance.CaseTables) -> DataFrame:
    parts = {"annual": tables.annual, "sex": tables.by_sex, "age_group": tables.by_age_group}
    keys = {"annual": F.lit(None).cast("string"), "sex": F.col("sexo"), "age_group": F.col("age_group")}
    return sequences.union_collections(
        *[part.select(F.lit(name).alias("kind"), "ano", keys[name].alias("key"), "casos") for name, part in parts.items()]
    )


def cases_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_ops.cases_by_region(standins.cases(spark, sf_dir), "dept")


def cases_by_region_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_ops.cases_by_region(standins.cases(spark, sf_dir), "dept", normalise_first=False)


def region_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = case_ops.cases_by_region(standins.cases(spark, sf_dir), "dept")
    named = region_ops.normalise_column(standins.regions(spark, sf_dir), "name")
    return region_ops.join_counts(named, counts, "name", "dept")


def region_map_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = case_ops.cases_by_region(standins.cases(spark, sf_dir), "dept", normalise_first=False)
    named = region_ops.normalise_column(standins.regions(spark, sf_dir), "name")
    return region_ops.join_counts(named, counts, "name", "dept")


def map_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveillance.region_map(standins.cases(spark, sf_dir), standins.regions(spark, sf_dir), "dept", "name")


def region_year_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveillance.region_year_map(
        standins.cases(spark, sf_dir), standins.regions(spark, sf_dir), *YEARS, "dept", "name", "fec_not"
    )


def region_year_map_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveillance.region_year_map(
        standins.cases(spark, sf_dir), standins.regions(spark, sf_dir), *YEARS, "dept", "name", "fec_txt"
    )


def one_year_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveillance.one_year_map(
        standins.cases(spark, sf_dir), standins.regions(spark, sf_dir), ONE_YEAR, "dept", "name", "fec_not"
    )


def region_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_ops.unmatched_names(standins.cases(spark, sf_dir), standins.regions(spark, sf_dir), "dept", "name")


def year_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_ops.year_levels(standins.cases(spark, sf_dir), "ano")


def distinct_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region names as spelled, in key order."""
    return case_ops.key_order(case_ops.distinct_values(standins.cases(spark, sf_dir), "dept"), "dept")


def blank_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_ops.blanks_to_null(standins.cases(spark, sf_dir))


def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = standins.cases(spark, sf_dir).select("case_id", "fec_txt", F.col("fec_txt").alias("parsed"))
    dated = case_ops.with_notification_year(dated, "parsed")
    return dated.withColumn("parsed", F.date_format("parsed", "yyyy-MM-dd"))


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiled = profile.column_profile(standins.table(spark, sf_dir, "lineitem"))
    return profiled.withColumn("mean", F.round("mean", 6))


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.preview(standins.cases(spark, sf_dir).select("case_id", "ano", "sexo", "edad", "dept"), ["case_id"])


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.structure(standins.table(spark, sf_dir, "orders"), ["o_orderkey"])


# Geometry and drawings


def region_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries in several reference systems, read and measured in their own."""
    shapes = geometry.with_polygons(standins.parcels(spark, sf_dir))
    return geometry.measured(shapes).drop("geometry", "polygons", "c_nationkey")


def region_wgs84(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of the same boundaries in degrees, and their areas in square metres."""
    shapes = geometry.to_wgs84(geometry.with_polygons(standins.parcels(spark, sf_dir)))
    found = geometry.measured(shapes, geographic=True)
    corners = [F.round(name, 7).alias(name) for name in ("xmin", "ymin", "xmax", "ymax")]
    return found.select("c_custkey", "epsg", *corners, F.round("area", 2).alias("area"))


def map_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of each nation's map."""
    shapes = geometry.to_wgs84(geometry.with_polygons(standins.parcels(spark, sf_dir)))
    found = geometry.map_extent(shapes, ["c_nationkey"])
    return found.select("c_nationkey", *[F.round(name, 7).alias(name) for name in ("xmin", "ymin", "xmax", "ymax")])


def map_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawing per year, written by one job; the regions in the files, read back."""
    path = scratch_path(spark, "drawings")
    maps.draw_region_years(standins.cases(spark, sf_dir), standins.boundaries(spark, sf_dir), path, *YEARS, "dept", "name", "fec_not")
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value").where("value like '<path fill-rule%'")

    def part(pattern: str) -> Column:
        return F.regexp_extract("value", pattern, 1)

    return lines.select(
        "file", part("<title>([^<:]*)").alias("name"), part("<title>[^<:]*: ([^<]*)").alias("casos"), part('fill="(#[^"]*)"').alias("colour"),
        part(' d="([^"]*)"').alias("data"),
    )


def _ordered_case_files(spark: SparkSession, sf_dir: str) -> str:
    """The cases in CSV files that are in the order of their numbers."""
    path = scratch_path(spark, "cases")
    written = standins.cases(spark, sf_dir).select("case_id", "ano", "sexo", "edad", "dept")
    ordered = written.repartitionByRange(6, "case_id").sortWithinPartitions("case_id")
    ordered.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


_ORDERED_COLUMNS = {"case_id": "bigint", "ano": "int", "sexo": "string", "edad": "double", "dept": "string"}


def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the files with its number."""
    return order.with_row_numbers(read_cases(spark, _ordered_case_files(spark, sf_dir), _ORDERED_COLUMNS)).select("case_id", "row")


def first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions in the order in which the files name them first."""
    return order.distinct_in_order(read_cases(spark, _ordered_case_files(spark, sf_dir), _ORDERED_COLUMNS), "dept")


def file_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the files."""
    listed = spark.read.text(_ordered_case_files(spark, sf_dir)).inputFiles()
    return order.first_rows(lambda files: read_cases(spark, list(files), _ORDERED_COLUMNS), listed, profile.PREVIEW_ROWS)


def sketched_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile merged from sketches of single years, held against the exact shares of its quartiles."""
    items = standins.table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    numbers = ["l_quantity", "l_extendedprice", "l_discount", "l_orderkey"]
    path = scratch_path(spark, "sketches")
    for odd in (0, 1):
        parts = sketches.add_to_sketches(items.where(F.col("year") % 2 == odd).select("year", *numbers), path, ["year"])
    found = sketches.sketched_profile(sketches.merge_sketches(parts))
    values = items.select(F.stack(F.lit(len(numbers)), *[x for c in numbers for x in (F.lit(c), F.col(c).cast("double"))]).alias("column", "value"))
    # One row per column.
    shares = values.join(F.broadcast(found.select("column", *profile.QUARTILES)), "column").groupBy("column").agg(*[
        F.struct(F.avg((F.col("value") < F.col(q)).cast("int")).alias("below"), F.avg((F.col("value") <= F.col(q)).cast("int")).alias("up_to")).alias(f"{q}_shares")
        for q in profile.QUARTILES
    ])
    most = 3 * sketches.rank_error()
    near = [((F.col(f"{q}_shares.below") <= share + most) & (F.col(f"{q}_shares.up_to") >= share - most)).alias(f"{q}_near") for q, share in profile.QUARTILES.items()]
    return found.join(shares, "column").select("column", "n", "missing", "min", F.round("mean", 4).alias("mean"), "max", *near)


def nearest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the regions don't have, and the regions they are nearest to."""
    return names.nearest_names(*standins.spelled_names(spark, sf_dir))


def case_files_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly files whose headers differ, matched by name."""
    return read_cases_by_header(spark, _yearly_files(spark, sf_dir), _YEARLY_COLUMNS).rows


def case_files_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What couldn't be read of the same files."""
    counts = read_cases_by_header(spark, _yearly_files(spark, sf_dir), _YEARLY_COLUMNS).rejected
    return counts.groupBy("cause").agg(F.sum("n").alias("n"))


_YEARLY_COLUMNS = {"case_id": "bigint", "ano": "int", "edad": "double", "dept": "string", "sexo": "string"}


def _yearly_files(spark: SparkSession, sf_dir: str) -> str:
    """The cases by the last digit of their number: some files with columns in another order, some without one, some with one more; some
    lines are cut short, and some ages are words."""
    path = scratch_path(spark, "yearly")
    age = F.when(F.col("case_id") % 31 == 7, F.lit("old")).otherwise(F.col("edad").cast("string"))
    cases = standins.cases(spark, sf_dir).select("case_id", "ano", age.alias("edad"), "dept", "sexo", F.lit("x, y").alias("extra"))
    layouts = (["case_id", "ano", "edad", "dept", "sexo"], ["sexo", "dept", "case_id", "edad", "ano"], ["case_id", "edad", "dept"], ["extra", "ano", "case_id", "edad", "dept", "sexo"])
    for number, layout in enumerate(layouts):
        part = cases.where(F.col("case_id") % len(layouts) == number).select(*layout)
        part.write.csv(f"{path}/layout-{number}", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    short = standins.cases(spark, sf_dir).where("case_id % 50 = 0").select(F.concat(F.col("case_id").cast("string"), F.lit(",1")).alias("case_id,ano,edad"))
    # One column whose name is the header of three, with lines of two fields; another separator leaves the commas as they are.
    short.write.csv(f"{path}/layout-9", header=True, sep=";")
    return f"{path}/layout-*"


# Sequences


def rules_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The serotype rules as rows of a table."""
    found = rules.match_rules(standins.documents(spark, sf_dir), rules.rules_table(spark))
    return found.select("doc_id", "serotype", "n_serotypes")


def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule per document, made of its letters, against all documents."""
    texts = standins.seqs(spark, sf_dir).select("doc_id", F.concat("description", F.lit(" "), "letters").alias("body"))
    return rules.match_rules(texts, standins.letter_rules(spark, sf_dir), label="rule").select("doc_id", "rule")


def ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.with_ambiguity(standins.seqs(spark, sf_dir)).select("doc_id", "n_ambiguous", "ambiguous_fraction")


def filter_ambiguous_0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.filter_ambiguous(standins.seqs(spark, sf_dir)).drop("letters")


def filter_ambiguous_5pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.filter_ambiguous(standins.seqs(spark, sf_dir), 0.05).drop("letters")


def ambiguity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.ambiguity_stats(standins.seqs(spark, sf_dir), 0.05)


def dna_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain letters of the documents as a DNA reader takes them."""
    return sequences.to_dna(standins.seqs(spark, sf_dir).select("doc_id", "letters"), "letters")


def purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.purge(standins.seqs(spark, sf_dir)).drop("letters")


def purge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.purge_stats(standins.seqs(spark, sf_dir))


def fasta_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fasta_sink.fasta_text(standins.seqs(spark, sf_dir)).select("doc_id", "entry")


def purged_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = curation.purge_records(standins.seqs(spark, sf_dir)).kept
    return fasta_sink.fasta_text(kept, PURGED_WIDTH).select("doc_id", "entry")


def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "fasta")
    fasta_sink.write_fasta(standins.seqs(spark, sf_dir), path)
    return read_fasta(spark, path).select("id", "description", "sequence")


def combined_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write one set per serotype, merge the sets into one text, read it back."""
    folder = scratch_path(spark, "sets")
    records = sequences.match_serotypes(standins.seqs(spark, sf_dir), text="description")
    fasta_sink.write_fasta(records, folder, PURGED_WIDTH, partition_by=["serotype"])
    output = scratch_path(spark, "combined")
    sets = [f"{folder}/serotype={label}" for label in SEROTYPE_PHRASES]
    fasta_sink.write_combined(read_fasta_entries(spark, sets), output, [folder])
    return read_fasta(spark, output).select("id", "description", "sequence")


def serotype_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.match_serotypes(standins.documents(spark, sf_dir)).select("doc_id", "serotype", "n_serotypes")


def all_serotypes_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets of all serotypes as one collection, from one pass over the documents."""
    return sequences.match_serotypes(standins.documents(spark, sf_dir)).select("doc_id", "serotype", "body")


def one_serotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.keep_serotype(standins.documents(spark, sf_dir), "DENV2").select("doc_id", "serotype", "body")


# Searching and fetching


def search_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_ids(standins.search_responses(spark, sf_dir))


def pages_before_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = standins.search_responses(spark, sf_dir)
    pages = responses.select("retstart", count_ids(F.col("body")).alias("n_ids"))
    return fetches.pages_before_cutoff(pages)


def search_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = standins.search_responses(spark, sf_dir)
    return fetches.search_cutoff(responses.select("retstart", count_ids(F.col("body")).alias("n_ids")))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every try of every request."""
    return standins.fetch_log(spark, sf_dir)


def numbered_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tries that the retry limit allows."""
    numbered = fetches.number_attempts(standins.tries(spark, sf_dir), ["ts", "event_id"])
    return numbered.select("id", "event_id", "attempt", "status")


def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetches.first_success(standins.fetch_log(spark, sf_dir))


def first_success_two_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetches.first_success(standins.fetch_log(spark, sf_dir), max_attempts=2)


def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = fetches.first_success(standins.fetch_log(spark, sf_dir))
    return sequences.classify(fetched, "DENV1").select("id", "outcome")


def curate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.curate(standins.fetch_log(spark, sf_dir)).stats


def curate_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.curate(standins.fetch_log(spark, sf_dir)).kept


def curate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.curate_search(standins.search_responses(spark, sf_dir), standins.fetch_log(spark, sf_dir)).stats


def curate_search_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.curate_search(standins.search_responses(spark, sf_dir), standins.fetch_log(spark, sf_dir)).kept


def curate_search_to_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts taken while the kept documents of a search are written."""
    log, responses = standins.fetch_log(spark, sf_dir), standins.search_responses(spark, sf_dir)
    return curation.curate_search_to_folder(responses, log, scratch_path(spark, "kept"))


def curate_search_to_folder_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is written for a search, read back."""
    path = scratch_path(spark, "kept")
    log, responses = standins.fetch_log(spark, sf_dir), standins.search_responses(spark, sf_dir)
    curation.curate_search_to_folder(responses, log, path)
    return spark.read.parquet(path).select("id", F.col("serotype").cast("string").alias("serotype"), "body")


def fetched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id of the log asked for again, with retries, from the replies that landed."""
    ids = standins.fetch_log(spark, sf_dir).select("id")
    log = land_documents(ids, scratch_path(spark, "documents"), **standins.landed_replies(spark, sf_dir))
    return fetches.first_success(log)


def fetch_and_curate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job on the same replies: search, fetch, judge."""
    return curation.fetch_and_curate(spark, scratch_path(spark, "landed"), pages_per_task=16, **standins.landed_replies(spark, sf_dir)).stats


def search_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of searches from a stream of their pages, which lands in four parts in an order of its own."""
    source, output, state = (scratch_path(spark, name) for name in ("pages", "progress", "state"))
    pages = standins.fetched_pages(spark, sf_dir)
    # Every task writes a file of each part that it has pages of; documents aren't moved for it.
    pages.withColumn("_file", F.pmod(F.xxhash64("search", "retstart"), F.lit(4))).write.partitionBy("_file").parquet(source)
    files = len(spark.read.parquet(source).inputFiles())
    before = spark.conf.get(progress.PROVIDER)
    spark.conf.set(progress.PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", max(1, -(-files // 4))).parquet(f"{source}/*")
        running = progress.search_progress(progress.page_counts(stream))
        sink = running.writeStream.format("parquet").option("path", output).option("checkpointLocation", state)
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(progress.PROVIDER, before)
    return progress.latest(spark.read.schema(running.schema).parquet(output))


def first_success_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that holds every third id's tries twice."""
    log = standins.fetch_log(spark, sf_dir)
    return fetches.first_success(log.unionByName(log.where("cast(id as bigint) % 3 = 0")))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records in the documents."""
    return records_of_documents(standins.documents(spark, sf_dir))


def _purge_by_serotype(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    kept = sequences.match_serotypes(standins.documents(spark, sf_dir)).select("doc_id", "serotype", "body")
    return curation.purge_by_serotype(kept, path)


def purge_by_serotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept documents, cut into records, purged, written by serotype and read back."""
    path = scratch_path(spark, "purged")
    _purge_by_serotype(spark, sf_dir, path)
    sets = [f"{path}/serotype={label}" for label in SEROTYPE_PHRASES]
    records = read_fasta(spark, sets)
    serotype = F.regexp_extract("source_file", "serotype=([^/]*)/", 1)
    return records.select(serotype.alias("serotype"), "id", "description", "sequence")


def purge_stats_by_serotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts taken on the way."""
    return _purge_by_serotype(spark, sf_dir, scratch_path(spark, "purged"))


# Files written and read back


def csv_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "cases")
    written = standins.cases(spark, sf_dir).select("case_id", "ano", "fec_txt", "sexo", "edad", "dept")
    written.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    columns = {"case_id": "bigint", "ano": "int", "fec_txt": "string", "sexo": "string", "edad": "double", "dept": "string"}
    return read_cases(spark, path, columns)


def geojson_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "regions")
    nation = standins.table(spark, sf_dir, "nation")
    feature = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.col("n_name").alias("DPTO_CNMBR"), "n_regionkey").alias("properties"),
            F.struct(F.lit("Point").alias("type"), F.array("n_nationkey", "n_regionkey").alias("coordinates")).alias("geometry"),
        )
    )
    nation.select(feature).write.text(path)
    return read_regions(spark, path, multi_line=False)


def _case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases written as CSV and read again."""
    path = scratch_path(spark, "cases")
    written = standins.cases(spark, sf_dir).select("ano", "sexo", "edad", "fec_txt", "dept")
    written.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_cases(spark, path, {"ano": "int", "sexo": "string", "edad": "double", "fec_txt": "string", "dept": "string"})


def _region_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions written as one feature collection, as boundaries come, and read again."""
    path = scratch_path(spark, "regions")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.concat(F.lit(" "), F.lower("n_name")).alias("DPTO_CNMBR")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("n_nationkey", "n_regionkey").alias("coordinates")).alias("geometry"),
    )
    # One row per region of the map.
    features = standins.table(spark, sf_dir, "nation").agg(F.collect_list(feature).alias("features"))
    features.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features"))).write.text(path)
    return read_regions(spark, path)


def case_tables_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_table(surveillance.case_tables(_case_files(spark, sf_dir), "ano", "sexo", "edad"))


def region_map_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveillance.region_map(_case_files(spark, sf_dir), _region_file(spark, sf_dir), "dept")


def region_year_map_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveillance.region_year_map(
        _case_files(spark, sf_dir), _region_file(spark, sf_dir), *YEARS, "dept", date="fec_txt"
    )


def fasta_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with text in front of their first header, doubled markers and empty records, cut while they are read."""
    return read_fasta(spark, _layouts(spark, sf_dir)).select("id", "description", "sequence")


def fasta_layouts_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files, each read whole."""
    return read_fasta(spark, _layouts(spark, sf_dir), whole_files=True).select("id", "description", "sequence")


def _layouts(spark: SparkSession, sf_dir: str, per_file: int = 1024) -> str:
    """Folders of one file each, with a note on top, and an empty record after every other one. There are as many as the documents fill."""
    marker = F.when(F.col("doc_id") % 3 == 0, ">").otherwise("")
    entry = F.concat_ws("\n", F.concat(F.lit(">"), marker, "description"), "sequence", F.lit(">"))
    texts = standins.seqs(spark, sf_dir).select("doc_id", entry.alias("value"), F.floor(F.col("doc_id") / per_file).alias("file"))
    note = F.lit("; a note > and\nanother").alias("value")
    files = standins.table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / per_file).alias("file")).distinct()
    notes = files.select(F.lit(-1).cast("long").alias("doc_id"), note, "file")
    folder = scratch_path(spark, "fasta")
    dealt = texts.unionByName(notes).repartition("file").sortWithinPartitions("file", "doc_id")
    dealt.select("file", "value").write.partitionBy("file").text(folder)
    return f"{folder}/file=*"


def fasta_bare_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose lines end in a bare carriage return, in a folder whose name looks like a pattern."""
    folder = f"{scratch_path(spark, 'fasta')}-[x]"
    fasta_sink.fasta_text(standins.seqs(spark, sf_dir)).select(F.replace("entry", F.lit("\n"), F.lit("\r"))).write.option("lineSep", "\r").text(folder)
    return read_fasta_folder(spark, folder).select("id", "description", "sequence")


def folder_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA at the top of a folder and in subfolders named like partitions: only the top is read."""
    folder = scratch_path(spark, "fasta")
    records = sequences.match_serotypes(standins.seqs(spark, sf_dir), text="description")
    fasta_sink.write_fasta(records, folder, PURGED_WIDTH, partition_by=["serotype"])
    fasta_sink.write_fasta(standins.seqs(spark, sf_dir), folder, mode="append")
    return read_fasta_folder(spark, folder).select("id", "description", "sequence")


def kept_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "kept")
    curation.curate_to_folder(standins.fetch_log(spark, sf_dir), path)
    return spark.read.parquet(path).select("id", F.col("serotype").cast("string").alias("serotype"), "body")


def curate_to_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts taken while the kept documents are written."""
    return curation.curate_to_folder(standins.fetch_log(spark, sf_dir), scratch_path(spark, "kept"))


def purge_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purge a folder of FASTA files and read the result."""
    source, output = scratch_path(spark, "fasta"), scratch_path(spark, "purged")
    fasta_sink.write_fasta(standins.seqs(spark, sf_dir), source)
    curation.purge_folder(spark, source, output, glob="part-*")
    return read_fasta(spark, output).select("id", "description", "sequence")


def purge_folder_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = scratch_path(spark, "fasta")
    fasta_sink.write_fasta(standins.seqs(spark, sf_dir), source)
    return curation.purge_folder(spark, source, scratch_path(spark, "purged"), glob="part-*")


def filter_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter FASTA files by their ambiguous characters and read the result."""
    source, output = scratch_path(spark, "fasta"), scratch_path(spark, "filtered")
    fasta_sink.write_fasta(standins.seqs(spark, sf_dir), source)
    curation.filter_fasta(spark, source, output, 0.05)
    return read_fasta(spark, output).select("id", "description", "sequence")


def filter_fasta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = scratch_path(spark, "fasta")
    fasta_sink.write_fasta(standins.seqs(spark, sf_dir), source)
    return curation.filter_fasta(spark, source, scratch_path(spark, "filtered"), 0.05)


def map_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "maps")
    write_region_years(region_year_map(spark, sf_dir), path)
    return spark.read.parquet(path).select("name", F.col("year").cast("int").alias("year"), "casos", "fill")


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        region_year_map,
        region_year_map_from_text,
        annual_cases,
        cases_by_sex,
        cases_by_age_group,
        case_tables,
        cases_by_region,
        cases_by_region_as_written,
        region_map,
        region_map_as_written,
        map_fill,
        one_year_map,
        region_reconcile,
        year_levels,
        distinct_regions,
        blank_to_null,
        parsed_dates,
        column_profile,
        preview,
        structure,
        region_geometry,
        region_wgs84,
        map_extents,
        map_files,
        row_numbers,
        first_appearance,
        file_head,
        sketched_profile,
        nearest_names,
        case_files_by_header,
        case_files_rejected,
        rules_table,
        many_rules,
        ambiguity,
        filter_ambiguous_0,
        filter_ambiguous_5pct,
        ambiguity_stats,
        dna_letters,
        purge,
        purge_stats,
        fasta_text,
        purged_fasta,
        fasta_round_trip,
        combined_fasta,
        serotype_matches,
        all_serotypes_union,
        one_serotype,
        document_records,
        purge_by_serotype,
        purge_stats_by_serotype,
        search_ids,
        pages_before_cutoff,
        search_cutoff,
        fetch_log,
        numbered_attempts,
        first_success,
        first_success_two_tries,
        first_success_repeated,
        fetched_documents,
        fetch_and_curate,
        search_progress,
        fetch_outcomes,
        curate,
        curate_kept,
        curate_search,
        curate_search_kept,
        curate_search_to_folder,
        curate_search_to_folder_kept,
        csv_cases,
        case_tables_from_files,
        region_map_from_files,
        region_year_map_from_files,
        fasta_layouts,
        fasta_layouts_whole,
        fasta_bare_returns,
        folder_children,
        geojson_regions,
        kept_partitions,
        curate_to_folder,
        purge_folder,
        purge_folder_stats,
        filter_fasta,
        filter_fasta_stats,
        map_partitions,
    )
}
