"""Reports as a data source of their own: ``format("pagescan-report")``.

A reporter says which lines a report has; the lines are made by Spark.  Tasks write them next to
the place they are for, and only when all have done so does the report appear there, so a failed task leaves none.
Files are written through Arrow's file systems: local and mounted folders, HDFS, S3 and the like.
"""

import sys
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "pagescan-report"


class Reporter:
    """What a report is made of.  ``lines`` gives ``no, line`` from findings; files begin with ``header`` and end with ``ending``."""

    ending = ".txt"
    header: str | None = None

    def lines(self, findings: DataFrame) -> DataFrame:
        raise NotImplementedError


@dataclass
class Written(WriterCommitMessage):
    """A task's file, under its temporary name."""

    name: str


def _place(path: str):
    """(file system, folder) of a path or URI."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path.rstrip("/")
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/").rstrip("/")
    found, folder = pafs.FileSystem.from_uri(path)
    return found, folder.rstrip("/")


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.header, self.ending = options.get("header"), options.get("ending", ".txt")
        self.open = f"{_place(self.path)[1]}/_unfinished-{self.job}"

    def write(self, iterator):
        from pyspark import TaskContext
        context, (system, _) = TaskContext.get(), _place(self.path)
        system.create_dir(self.open, recursive=True)
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}{self.ending}"
        rows = 0
        with system.open_output_stream(f"{self.open}/{name}") as out:
            for batch in iterator:
                if rows == 0 and batch.num_rows and self.header is not None:
                    out.write(self.header.encode() + b"\n")
                rows += batch.num_rows
                for line in batch.column(0):
                    out.write((line.as_py() or "").encode() + b"\n")
        return Written(name if rows else "")

    def commit(self, messages):
        system, folder = _place(self.path)
        names = [m.name for m in messages if m is not None and m.name]
        if self.overwrite:
            for old in system.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                if old.base_name.startswith("part-") and old.type == pafs.FileType.File:
                    system.delete_file(old.path)
        for name in names:
            system.move(f"{self.open}/{name}", f"{folder}/{name}")
        self._clear(system)

    def abort(self, messages):
        self._clear(_place(self.path)[0])

    def _clear(self, system):
        if system.get_file_info(self.open).type == pafs.FileType.Directory:
            system.delete_dir(self.open)


class ReportSource(DataSource):
    """``df(line).write.format("pagescan-report").option("header", ...).option("ending", ...).save(path)``"""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "line STRING"

    def writer(self, schema, overwrite):
        return ReportWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(ReportSource)


def write_report(findings: DataFrame, path: str, reporter: Reporter) -> None:
    """The report of some findings, in place of one that is there."""
    write_lines(reporter.lines(findings), path, reporter)


def write_lines(lines: DataFrame, path: str, reporter: Reporter) -> None:
    """Lines in the order of ``no``, file after file."""
    register(lines.sparkSession)
    writer = lines.orderBy("no").select("line").write.format(FORMAT).option("ending", reporter.ending)
    if reporter.header is not None:
        writer = writer.option("header", reporter.header)
    writer.mode("overwrite").save(path)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
