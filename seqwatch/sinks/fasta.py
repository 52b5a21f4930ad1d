"""FASTA text output. The output is a folder of part files; together, in name order, they are the text."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqwatch.functions.sequences import FILTERED_WIDTH, fasta_entry
from seqwatch.operators.order import MOST_BROADCAST, block_offsets
from seqwatch.sinks.line_files import located, write_line_files
from seqwatch.sources.fasta import FILE_ORDER


def fasta_text(records: DataFrame, width: int = FILTERED_WIDTH) -> DataFrame:
    """The records as FASTA text, one row per record."""
    return records.withColumn("entry", fasta_entry(F.col("description"), F.col("sequence"), width))


def write_fasta(
    records: DataFrame,
    path: str,
    width: int = FILTERED_WIDTH,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    mode: str = "error",
) -> None:
    """Write records as FASTA, with ``partition_by`` into one folder per value, in a single pass.

    Without ``order_by`` nothing is shuffled.
    """
    ordered = records.orderBy(*order_by) if order_by else records
    text = fasta_text(ordered, width).select(*partition_by, "entry")
    text.write.mode(mode).partitionBy(*partition_by).text(path)


def write_combined(entries: DataFrame, path: str, inputs: Sequence[str] = (), in_file_order: bool = True) -> None:
    """Overwrite ``path`` with the text of all records as they stand, in file-name order.

    The text is not moved for that: the blocks of the files are counted, and every task writes each block it reads as the part of
    its place. So ``entries`` are as ``read_fasta_entries`` gives them, at most filtered. On a file system that only Spark reaches the
    order costs a sort of the whole text; without it every task writes what it reads. The output must not lie in or above an input, where the next run would read it again or lose it: neither
    the ``inputs`` named nor the folders of the files that the entries come from.
    """
    output = qualified(entries.sparkSession, path)
    for source in {*inputs, *(posixpath.dirname(file) for file in entries.inputFiles())}:
        if _overlap(output, qualified(entries.sparkSession, source)):
            raise ValueError(f"output {path} overlaps input {source}")
    if in_file_order and _reachable(output):
        placed = entries.select("source_file", "block_start", "entry").withColumn("_at", F.monotonically_increasing_id())
        blocks = block_offsets(placed).select("source_file", "block_start", "_offset")
        if entries.rdd.getNumPartitions() <= MOST_BROADCAST:
            blocks = F.broadcast(blocks)
        name = F.format_string("part-%018d", F.col("_offset"))
        lines = placed.join(blocks, ["source_file", "block_start"]).select(name.alias("file"), "entry")
        write_line_files(lines, output, mode="overwrite", line="entry", in_place=True)
        return
    ordered = entries.orderBy(*FILE_ORDER) if in_file_order else entries
    ordered.select("entry").write.mode("overwrite").text(path)


def _reachable(path: str) -> bool:
    """Whether tasks can write there by themselves."""
    try:
        located(path)
    except (ValueError, OSError, ImportError):
        return False
    return True


def qualified(spark: SparkSession, path: str) -> str:
    """The path as its file system sees it: with scheme and working folder, without detours."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = urlsplit(system.makeQualified(place).toString())
    return f"{parts.scheme}://{parts.netloc}{posixpath.normpath('/' + unquote(parts.path).lstrip('/'))}"


def _overlap(one: str, other: str) -> bool:
    first, second = one.rstrip("/") + "/", other.rstrip("/") + "/"
    return first.startswith(second) or second.startswith(first)
