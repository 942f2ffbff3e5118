"""Mail providers as a data source: ``spark.read.format("mail_folder").load(path)``, read in parallel and filtered by day and label at the source."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "label string, received_at timestamp, file string, raw binary"


@dataclass
class Messages(InputPartition):
    """The message files of one label."""

    label: str
    files: list[str]


class MailFolderReader(DataSourceReader):
    """One folder per label, one file per message; the file's time is when the message came in."""

    def __init__(self, path: str, slices: int):
        self.path, self.slices = path, slices
        self.label: str | None = None
        self.since: dt.datetime | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("label",):
                self.label = f.value
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("received_at",):
                self.since = max(filter(None, [self.since, f.value]))
                if isinstance(f, GreaterThan):
                    yield f  # equal times are left out by the engine
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        where, at = fs.FileSystem.from_uri(self.path)
        out = []
        for folder in where.get_file_info(fs.FileSelector(at)):
            if folder.type != fs.FileType.Directory or self.label not in (None, folder.base_name):
                continue
            files = [x.path for x in where.get_file_info(fs.FileSelector(folder.path)) if x.type == fs.FileType.File and (self.since is None or x.mtime.timestamp() >= self.since.timestamp())]
            out += [Messages(folder.base_name, sorted(files)[k :: self.slices]) for k in range(min(self.slices, len(files)))]
        return out or [Messages("", [])]

    def read(self, partition: Messages) -> Iterator[tuple]:
        from pyarrow import fs

        where, _ = fs.FileSystem.from_uri(self.path)
        for file in partition.files:
            when = dt.datetime.fromtimestamp(where.get_file_info(file).mtime.timestamp(), dt.timezone.utc)
            with where.open_input_stream(file) as f:
                yield partition.label, when, file.rsplit("/", 1)[-1], f.read()


class MailFolder(DataSource):
    """The provider interface's file implementation; others need the same four columns."""

    @classmethod
    def name(cls) -> str:
        return "mail_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return MailFolderReader(self.options["path"], int(self.options.get("slices", "8")))


def register(spark: SparkSession) -> None:
    """Make the provider known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MailFolder)
