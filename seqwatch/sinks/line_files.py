"""Named text files written by tasks: all of a job's files appear, or none.

A Python data source. Tasks write below a folder of the run's own, the driver moves what the
successful attempts wrote when all are done, and removes everything when one fails for good.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from seqwatch.session import ship_package


def write_line_files(
    lines: DataFrame, path: str, order: Sequence[str] = (), mode: str = "error", file: str = "file", line: str = "line", in_place: bool = False
) -> None:
    """One file per name in ``file``, with the lines in the order of the columns ``order``.

    With ``in_place`` nothing is moved: each file's lines are in one task already, one after the other in their order.

    A file is written by one task, line by line, so it may be longer than memory. ``mode``: "error" refuses a folder that has files,
    "append" one that has a file of the same name, "overwrite" removes what is there, in the moment the new files take their places.
    """
    spark = lines.sparkSession
    if mode not in ("error", "append", "overwrite"):
        raise ValueError("mode is 'error', 'append' or 'overwrite'")
    ship_package(spark)
    spark.dataSource.register(LineFiles)
    dealt = lines if in_place else lines.repartition(file).sortWithinPartitions(file, *order)
    dealt = dealt.select(lines[file].alias("file"), lines[line].alias("line"))
    writer = dealt.write.format(LineFiles.name()).option("path", path).option("strict", str(mode == "error").lower())
    writer.mode("overwrite" if mode == "overwrite" else "append").save()


class LineFiles(DataSource):
    """Written only."""

    @classmethod
    def name(cls) -> str:
        return "seqwatch_line_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return LineFilesWriter(self.options["path"], overwrite, self.options.get("strict") == "true")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it, of a path with or without a scheme."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class LineFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, strict: bool):
        self.path, self.overwrite, self.strict = path, overwrite, strict
        self.run = f"_run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = located(self.path)
        context = TaskContext.get()
        own = f"{folder}/{self.run}/{context.partitionId()}-{context.taskAttemptId()}"
        written: list[tuple[str, str]] = []
        out = None
        try:
            for batch in iterator:
                for name, line in zip(*(batch.column(c).to_pylist() for c in ("file", "line")), strict=True):
                    if not written or written[-1][1] != name:
                        if not name or "/" in name or name[0] in "._" or any(name == known for _, known in written):
                            raise ValueError(f"not a name for a file here: {name!r}")
                        if out:
                            out.close()
                        if not written:
                            system.create_dir(own, recursive=True)
                        written.append((f"{own}/{name}", name))
                        out = system.open_output_stream(written[-1][0])
                    out.write((line or "").encode("utf-8") + b"\n")
        finally:
            if out:
                out.close()
        return Written(written)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = located(self.path)
        files = [pair for message in messages if message for pair in message.files]
        present = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        old = [info for info in present if info.base_name != self.run and not info.base_name.startswith((".", "_"))]
        names = {name for _, name in files}
        if not self.overwrite and (self.strict and old or names & {info.base_name for info in old}):
            self.abort(messages)
            raise FileExistsError(f"{self.path} has files already")
        if self.overwrite:
            for info in old:
                (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
        system.create_dir(folder, recursive=True)
        for staged, name in files:
            system.move(staged, f"{folder}/{name}")
        self._clear(system, folder)
        with system.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = located(self.path)
        self._clear(system, folder)

    def _clear(self, system: fs.FileSystem, folder: str) -> None:
        if system.get_file_info(f"{folder}/{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{folder}/{self.run}")
