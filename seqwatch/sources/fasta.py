"""FASTA text as a DataFrame of records.

Columns: ``source_file``, ``block_start``, ``position`` and ``part`` (together they order the records as they
stand in the files), ``id`` (first word of the header), ``description`` (the header) and ``sequence``
(lines joined, blanks removed); or, for merging, ``entry`` (the record's text as it stands).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqwatch.functions.sequences import without_blanks
from seqwatch.operators.derived import computed_once

# Files by their ending, and the parts that this library writes.
FASTA_GLOB = "{*.fasta,part-*}"

FILE_ORDER = ("source_file", "block_start", "position", "part")

#: Files that a list of one row each is broadcast for.
MOST_BROADCAST = 100_000

_PATTERN_CHARACTERS = "\\*?[]{}"


def read_fasta(spark: SparkSession, path: str | list[str], glob: str | None = None, whole_files: bool = False) -> DataFrame:
    """Records of FASTA files. What stands in front of a file's first header is left out.

    By default files are cut at every line that starts with ``>`` while they are read, so one large
    file is read by many tasks and a task holds one record at a time. Which piece is a file's first is
    found by a narrow aggregate, one row per file, so the text is gone through twice. Lines may end in LF, CRLF or CR; a file
    whose lines all end in a bare CR has no place to be cut at while it is read, and one task reads it whole.

    ``whole_files=True`` reads each file as one value, once: right for many small files. ``position`` is
    then the record's number in its file.

    A path that exists as written is that file or folder, whatever characters are in its name; others may be patterns.
    """
    return to_records(_pieces(spark, path, glob, whole_files), FILE_ORDER)


def records_of_documents(documents: DataFrame, text: str = "body") -> DataFrame:
    """The records in a column of FASTA documents, with the documents' other columns and their ``number`` in it.

    A document without a header, or NULL, has no records. Each document is cut in its own row: nothing moves.
    """
    others = [name for name in documents.columns if name not in (text, "number", "id", "description", "sequence")]
    pieces = documents.select(*[f"`{name}`" for name in others], _cut(F.col(text)).alias("number", "piece")).where("number > 0")
    return to_records(pieces, [*others, "number"])


def to_records(pieces: DataFrame, others: Sequence[str]) -> DataFrame:
    """The id, description and sequence of each ``piece``, a record without its marker."""
    description = F.rtrim(F.substring_index("piece", "\n", 1), F.lit(" \t\r"))
    lines = F.split("piece", "\n")
    joined = F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "")
    records = pieces.select(
        *[f"`{name}`" for name in others],
        F.regexp_extract(description, r"^\s*(\S*)", 1).alias("id"),
        description.alias("description"),
        without_blanks(joined).alias("sequence"),
    )
    return computed_once(records, "id", "description", "sequence")


def read_fasta_entries(
    spark: SparkSession, path: str | list[str], glob: str | None = None, whole_files: bool = False
) -> DataFrame:
    """Records as they stand: each one's own lines with plain line ends, without the last one."""
    # A record that another one follows has lost its line end already.
    lines = F.col("piece")
    entry = F.concat(F.lit(">"), F.when(lines.endswith("\n"), F.left(lines, F.length(lines) - 1)).otherwise(lines))
    return _pieces(spark, path, glob, whole_files).select(*FILE_ORDER, entry.alias("entry"))


def read_fasta_folder(spark: SparkSession, folder: str, glob: str = FASTA_GLOB, whole_files: bool = False) -> DataFrame:
    """Records of every file directly in a folder whose name fits; an error when there are none."""
    return read_fasta(spark, children(spark, folder, glob), whole_files=whole_files)


def read_folder_entries(spark: SparkSession, folder: str, glob: str = FASTA_GLOB, whole_files: bool = False) -> DataFrame:
    """``read_fasta_folder`` for merging: the records as they stand."""
    return read_fasta_entries(spark, children(spark, folder, glob), whole_files=whole_files)


def children(spark: SparkSession, folder: str, glob: str) -> str:
    """A path that stands for the files directly in the folder.

    The files are named by a pattern, not found by way of the folder, so subfolders like ``k=v`` are neither read
    nor taken for partitions. Only the listing decides whether there are any; a file may be empty.
    """
    pattern = f"{escaped(folder.rstrip('/'))}/{glob}"
    try:
        spark.read.text(pattern)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no FASTA files {pattern}") from None
    return pattern


def escaped(path: str) -> str:
    """A path whose characters all stand for themselves, where patterns are understood."""
    return "".join(f"\\{c}" if c in _PATTERN_CHARACTERS else c for c in path)


def _as_named(spark: SparkSession, path: str | list[str]) -> str | list[str]:
    if not isinstance(path, str):
        return [_as_named(spark, one) for one in path]
    if not any(c in _PATTERN_CHARACTERS for c in path):
        return path
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return escaped(path) if exists else path


def _plain_ends(text: Column) -> Column:
    """The text with all line ends as line feeds."""
    plain = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(text.contains("\r"), plain).otherwise(text)


def _cut(text: Column) -> Column:
    """The text cut at its headers; piece 0 is what stands in front of the first one."""
    return F.posexplode(F.split(_plain_ends(text), "(^|\n)>"))


def _pieces(spark: SparkSession, path: str | list[str], glob: str | None, whole_files: bool) -> DataFrame:
    """The text of each record, without its marker, and where it stands."""
    path = _as_named(spark, path)
    if whole_files:
        files = spark.read.text(path, wholetext=True, pathGlobFilter=glob).select(
            F.col("_metadata.file_path").alias("source_file"),
            F.lit(0).cast("long").alias("block_start"),
            _cut(F.col("value")).alias("number", "piece"),
        )
        files = files.where("number > 0").withColumns({"position": F.col("number").cast("long"), "part": F.lit(0)})
        return files.select(*FILE_ORDER, "piece")
    read = spark.read.text(path, lineSep="\n>", pathGlobFilter=glob)
    chunks = read.select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        # Rows of one file block are read in order by one task, so this orders them within the block.
        F.monotonically_increasing_id().alias("position"),
    )
    # One row per file, of which the driver has the list.
    first = chunks.where("block_start = 0").groupBy("source_file").agg(F.min("position").alias("position"))
    first = first.withColumn("is_first", F.lit(True))
    if len(read.inputFiles()) <= MOST_BROADCAST:
        first = F.broadcast(first)
    chunks = chunks.join(first, ["source_file", "position"], "left")
    # A chunk is a record and its line end, or, after a bare CR, several.
    value = _plain_ends(F.col("value"))
    parts = F.when(value.contains("\n>"), F.split(value, "\n>")).otherwise(F.array(value))
    pieces = chunks.select("source_file", "block_start", "position", "is_first", F.posexplode(parts).alias("part", "value"))
    # A file's first piece keeps its marker, or has none and is no record. In others a marker belongs to the header.
    at_start = F.col("is_first") & (F.col("part") == 0)
    text = F.when(at_start, F.substr(F.col("value"), F.lit(2))).otherwise(F.col("value"))
    return pieces.where(at_start.isNull() | ~at_start | F.col("value").startswith(">")).select(*FILE_ORDER, text.alias("piece"))
