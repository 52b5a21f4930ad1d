"""Case line lists in CSV."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping
from functools import reduce
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqwatch.session import ship_package
from seqwatch.sinks.line_files import located
from seqwatch.sources.fasta import escaped

# The columns of a case line list that the tables are made from, and their types.
CASE_COLUMNS = {
    "ANO": "int",
    "SEXO": "string",
    "EDAD": "double",
    "FEC_NOT": "string",
    "Departamento_ocurrencia": "string",
}

# Fixed value: the text that stands for a missing value.
MISSING = "NA"


def read_cases(
    spark: SparkSession,
    path: str | list[str],
    columns: Mapping[str, str] = CASE_COLUMNS,
    multi_line: bool = False,
) -> DataFrame:
    """The named columns of comma-separated files with a header.

    Columns are taken by header name, whatever their order and however many others there are; files
    whose header differs from the first one's are refused. Text stays text, blanks included; a number
    that cannot be read, or is not whole where a whole one is wanted, is NULL. ``multi_line`` allows line breaks inside quotes, at the price that a
    file is read by one task.
    """
    lines = spark.read.csv(
        path,
        header=True,
        nullValue=MISSING,
        escape='"',
        enforceSchema=False,
        multiLine=multi_line,
    )
    return lines.select(*[_typed(name, kind) for name, kind in columns.items()])


def _typed(name: str, kind: str):
    column = F.col(f"`{name}`")
    if kind == "int":
        # "2010.0" and "2e3" are whole numbers too, 2010.7 is none.
        number = column.try_cast("double")
        column = F.when(number == F.floor(number), number)
    return column.try_cast(kind).alias(name)


#: Different headers that a folder's files may have.
MOST_HEADERS = 1_000
#: Bytes at the beginning of a file that its header is looked for in.
HEADER_BYTES = 1 << 20


class CaseFiles(NamedTuple):
    """The rows of files whose headers differ, the counts of what couldn't be read, and every file's header. All are lazy."""

    rows: DataFrame
    rejected: DataFrame
    headers: DataFrame


def read_cases_by_header(spark: SparkSession, path: str | list[str], columns: Mapping[str, str] = CASE_COLUMNS) -> CaseFiles:
    """``read_cases`` for files each with a header of its own: yearly exports that gained, lost or moved columns.

    Columns are matched by name, file by file; one that a file doesn't have is NULL there. ``rejected`` (file, cause, n) counts by file
    the lines with another number of fields than the header, which give no row, and the values that aren't what their column
    wants, which are NULL. An empty file has no header and no rows. Names that a header repeats are taken where they stand first.
    """
    listed = spark.read.text(path).inputFiles()
    if not listed:
        raise FileNotFoundError(f"no files {path}")
    ship_package(spark)
    files = spark.createDataFrame([(unquote(file),) for file in listed], "file string").repartition(min(len(listed), 256))
    headers = files.mapInArrow(_first_lines, "file string, header string")
    kinds = headers.where("header is not null").groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    found = kinds.orderBy("header").limit(MOST_HEADERS + 1).collect()  # names of files, which the driver has listed
    if len(found) > MOST_HEADERS:
        raise ValueError(f"the files have more than {MOST_HEADERS} different headers")
    rows, rejected = [], []
    for kind in found:
        names = next(csv.reader([kind.header]))
        raw = [f"_{i}" for i in range(len(names))]
        schema = ", ".join([*[f"{name} string" for name in raw], "_bad string"])
        # Without pruning, so that every line's fields are counted whatever is wanted of them.
        lines = spark.read.option("columnPruning", False).csv(
            [escaped(file) for file in kind.files], schema, header=True, enforceSchema=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_bad"
        )
        lines = lines.select("*", F.col("_metadata.file_path").alias("_file"))
        place = {name: raw[names.index(name)] for name in columns if name in names}
        # An empty field and the text for a missing value are both none.
        text = {name: F.nullif(F.nullif(F.col(at), F.lit(MISSING)), F.lit("")) for name, at in place.items()}
        typed = {name: _read_as(text[name], kind_) if name in text else F.lit(None).cast(kind_) for name, kind_ in columns.items()}
        rows.append(lines.where("_bad is null").select(*[value.alias(name) for name, value in typed.items()]))
        causes = [F.when(F.col("_bad").isNotNull(), F.lit("number of fields"))]
        causes += [F.when(F.col("_bad").isNull() & text[name].isNotNull() & typed[name].isNull(), F.lit(f"value of {name}")) for name in text]
        rejected.append(lines.select("_file", F.explode(F.array_compact(F.array(*causes))).alias("cause")))
    if not rows:
        empty = ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
        return CaseFiles(spark.createDataFrame([], empty), spark.createDataFrame([], "file string, cause string, n bigint"), headers)
    counted = reduce(DataFrame.unionByName, rejected).groupBy(F.col("_file").alias("file"), "cause").agg(F.count(F.lit(1)).alias("n"))
    return CaseFiles(reduce(DataFrame.unionByName, rows), counted, headers)


def _read_as(text: Column, kind: str) -> Column:
    if kind == "int":
        number = text.try_cast("double")
        text = F.when(number == F.floor(number), number)
    return text.try_cast(kind)


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = batch.column("file").to_pylist()
        lines = []
        for file in files:
            system, place = located(file)
            with system.open_input_stream(place) as text:
                start = text.read(HEADER_BYTES).decode("utf-8", "replace").removeprefix("\ufeff")
            lines.append(start.splitlines()[0] if start.strip("\r\n") else None)
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(lines, pa.string())], names=["file", "header"])
