"""Searching and fetching as Spark jobs: pages of a search by a Python data source, documents by id.

Requests, their retries and pauses happen in tasks, side by side. What failed is a row. Whatever was
answered is landed in a table at once, so nothing is asked for twice, whatever is done with it later.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from seqwatch.operators.fetches import MAX_ATTEMPTS, PAGE_SIZE, search_cutoff
from seqwatch.session import ship_package
from seqwatch.sources.search import count_ids
from seqwatch.sources.transport import FETCH, PAUSE, SEARCH, bucket_column, place_of, request, transport_of

PAGES = "retstart bigint, attempt int, status int, body string, error string"
DOCUMENTS = "id string, attempt int, status int, body string, error string"

#: Pages that are asked for at first; then twice as many at a time.
FIRST_PAGES = 8
#: Rows that are handed on at once, since a task may wait long for the next one.
TOGETHER = 100


@dataclass
class Pages(InputPartition):
    """Offsets that one task asks for, one after the other."""

    offsets: tuple[int, ...]


class SearchPages(DataSource):
    """Pages of a search. Options: ``transport`` and its own; ``first``, ``pages``, ``step``, ``pages_per_task``, ``max_attempts``, ``pause``."""

    @classmethod
    def name(cls) -> str:
        return "seqwatch_search"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return SearchReader(dict(self.options))


class SearchReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.options = options
        self.step = int(options.get("step", PAGE_SIZE))
        self.first, self.pages = int(options.get("first", 0)), int(options["pages"])
        self.per_task = int(options.get("pages_per_task", 1))

    def partitions(self) -> list[InputPartition]:
        offsets = [self.first + i * self.step for i in range(self.pages)]
        return [Pages(tuple(offsets[i : i + self.per_task])) for i in range(0, len(offsets), self.per_task)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        transport = transport_of(self.options)
        for offset in partition.offsets:
            yield (offset, *request(transport, SEARCH, str(offset), *_patience(self.options)))


def _patience(options: Mapping[str, str]) -> tuple[int, float]:
    return int(options.get("max_attempts", MAX_ATTEMPTS)), float(options.get("pause", PAUSE))


def read_search_pages(spark: SparkSession, pages: int, first: int = 0, **options: object) -> DataFrame:
    """retstart, attempt, status, body, error of ``pages`` pages from offset ``first`` on: each page as its last try left it.

    A task per page, or per ``pages_per_task`` pages where asking takes less than starting a task.
    """
    ship_package(spark)
    spark.dataSource.register(SearchPages)
    reader = spark.read.format(SearchPages.name()).options(pages=pages, first=first)
    return reader.options(**{name: str(value) for name, value in options.items()}).load()


def land_search(spark: SparkSession, path: str, first_pages: int = FIRST_PAGES, step: int = PAGE_SIZE, **options: object) -> DataFrame:
    """Ask for pages until one is empty or fails, in jobs of twice as many pages each, and land all answers at ``path``.

    Returns the landed pages. At most about twice as many are asked for as the search has; ``pages_before_cutoff`` tells which count. Run
    again over the same path, it goes on behind the last whole job's pages.
    """
    landed, pages = 0, first_pages
    while True:
        part = f"{path.rstrip('/')}/first={landed}"
        chunk = _landed(spark, part, PAGES)
        if chunk is None:
            read_search_pages(spark, pages, landed * step, step=step, **options).write.mode("overwrite").parquet(part)
            chunk = spark.read.schema(PAGES).parquet(part)
        counted = chunk.select((F.col("retstart") - landed * step).alias("retstart"), count_ids(F.col("body")).alias("n_ids"))
        # A job's pages are a search of their own: it ends in them, or where they do.
        if search_cutoff(counted, step=step).first().cut < pages * step:
            return spark.read.schema(PAGES).parquet(*[f"{path.rstrip('/')}/first={n}" for n in _starts(first_pages, landed)])
        landed, pages = landed + pages, pages * 2


def _starts(first_pages: int, last: int) -> list[int]:
    starts, at, pages = [], 0, first_pages
    while at <= last:
        starts.append(at)
        at, pages = at + pages, pages * 2
    return starts


def _landed(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """What a finished job has written there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return None


def fetch_documents(ids: DataFrame, tasks: int | None = None, **options: object) -> DataFrame:
    """id, attempt, status, body, error for every different id: the document, or why there is none.

    ``tasks`` bounds how many requests are under way at once, for servers that set a limit; without it, it is the session's shuffle
    partitions. Ids that are answered from one place are asked for one after the other. Every use of the result asks again; ``land_documents``
    asks once.
    """
    ship_package(ids.sparkSession)
    settings = {name: str(value) for name, value in options.items()}

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transport, held = transport_of(settings), []
        for batch in batches:
            for key in batch.column("id").to_pylist():
                held.append((key, *request(transport, FETCH, key, *_patience(settings))))
                if len(held) >= TOGETHER:
                    yield _rows(held)
                    held = []
        if held:
            yield _rows(held)

    different = ids.select(F.col("id").cast("string").alias("id")).where("id is not null").distinct()
    # A number of its own keeps adaptive execution from making one task of ids that are short but long to fetch.
    tasks = tasks or int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = place_of(FETCH, F.col("id"), settings)
    dealt = different.repartition(tasks, "id") if place is None else different.repartition(tasks, place).sortWithinPartitions(place)
    return dealt.mapInArrow(fetch, DOCUMENTS)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*held), kinds, strict=True)], names=["id", "attempt", "status", "body", "error"])


def land_documents(ids: DataFrame, path: str, tasks: int | None = None, again: bool = False, **options: object) -> DataFrame:
    """``fetch_documents`` appended to the table at ``path``, for the ids that aren't there yet; returns the table.

    The table is a fetch log like any other, for ``first_success`` or ``curate``. With ``again``, ids that failed before are asked for once
    more and have a row for each time.
    """
    spark = ids.sparkSession
    known = _landed(spark, path, DOCUMENTS)
    if known is not None:
        done = known.where("body is not null") if again else known
        ids = ids.join(done.select("id"), "id", "left_anti")
    fetch_documents(ids, tasks, **options).write.mode("append").parquet(path)
    return spark.read.schema(DOCUMENTS).parquet(path)


def land_replies(log: DataFrame, path: str, buckets: int) -> None:
    """Write a log (kind, key, attempt, status, body) as the folder that the transport "folder" reads."""
    number = bucket_column(F.col("kind"), F.col("key"), buckets)
    line = F.to_json(F.struct("kind", "key", "attempt", "status", "body"))
    lines = log.select(number.alias("bucket"), line.alias("value"))
    lines.repartition("bucket").write.partitionBy("bucket").text(path)
