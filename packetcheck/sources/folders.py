"""A folder of project folders as a data source.

The root is listed once, by names alone; its project folders are dealt out to tasks, which list their files and
read those texts that are asked for. A folder without files yields one row without a path. Any
store that Arrow's file systems reach will do (local or mounted folders, hdfs://, s3://, gs://).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from packetcheck import vocab
from packetcheck.session import store_of, stored

SCHEMA = "project_name string, path string, length bigint, mtime timestamp, text string, error string"
TEXT_ERROR = "无法读取网页详情文件"
_ARROW = pa.schema([
    ("project_name", pa.string()), ("path", pa.string()), ("length", pa.int64()),
    ("mtime", pa.timestamp("us", tz="UTC")), ("text", pa.string()), ("error", pa.string()),
])
#: Rows and bytes of texts that a batch holds, one text more at most.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20
#: Folders that a task lists at least, and how many tasks there are at most where that isn't set: each leaves a file.
FOLDERS, TASKS = 256, 4096


def is_project_name(name: str) -> bool:
    return not name.startswith(".") and name not in vocab.RESERVED_DIRS


@dataclass
class Projects(InputPartition):
    """Names of the project folders that a task lists, with slashes between them: millions are on their way at once."""

    names: str


class PacketFolders(DataSource):
    """``spark.read.format("packet_folders").load(root)``.

    Options: ``texts``, the suffix of files whose text is read (``.txt``; empty for none), and
    ``batch``, how many folders a task lists (by default 256, or more where that would be too many tasks).
    """

    @classmethod
    def name(cls) -> str:
        return "packet_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(self.options)


def folder_names(path: str) -> Iterator[str]:
    """Names of the project folders below a root, which may be absent."""
    store, root = store_of(path)
    if isinstance(store, fs.LocalFileSystem):
        # what is a folder stands in the listing: nothing need be asked of each
        try:
            with os.scandir(root) as found:
                yield from (x.name for x in found if is_project_name(x.name) and x.is_dir())
        except FileNotFoundError:
            pass
        return
    for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if x.type == fs.FileType.Directory and is_project_name(x.base_name):
            yield x.base_name


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.suffix = options.get("texts", ".txt").lower()
        self.batch = int(options["batch"]) if "batch" in options else None

    def partitions(self) -> list[InputPartition]:
        # names are packed as they come: one object for each folder would take more than the folders' rows
        names, dealt = folder_names(self.root), []
        while some := list(islice(names, self.batch or FOLDERS)):
            dealt.append("/".join(some))
        step = 1 if self.batch else -(-len(dealt) // TASKS) or 1
        # a source without a partition would be read as one without a value
        return [Projects("/".join(dealt[k:k + step])) for k in range(0, len(dealt), step)] or [Projects("")]

    def read(self, partition: Projects) -> Iterator[pa.RecordBatch]:
        store, root = store_of(self.root)
        rows, held = [], 0
        for name in filter(None, partition.names.split("/")):
            files = store.get_file_info(fs.FileSelector(f"{root}/{name}", allow_not_found=True))
            kept = sorted((x for x in files if x.type == fs.FileType.File), key=lambda x: x.base_name)
            for file in kept:
                text, error = self._text(store, file)
                mtime = file.mtime if isinstance(file.mtime, datetime) else None
                rows.append((name, f"{self.root}/{name}/{file.base_name}", file.size, mtime and mtime.astimezone(UTC), text, error))
                held += len(text or "")
            if not kept:
                rows.append((name, None, None, None, None, None))
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _text(self, store: fs.FileSystem, file: fs.FileInfo) -> tuple[str | None, str | None]:
        if not self.suffix or not file.base_name.lower().endswith(self.suffix):
            return None, None
        try:
            with store.open_input_stream(file.path) as stream:
                return stream.read().decode(), None
        except (OSError, UnicodeDecodeError):
            return None, f"{TEXT_ERROR}: {file.base_name}"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


@dataclass(frozen=True)
class Listing:
    """What lies below a root: files, their texts, and all project folders."""

    files: DataFrame
    texts: DataFrame
    folders: DataFrame


def list_folders(spark: SparkSession, root: str, **options: str) -> Listing:
    """Project folders below ``root``, listed once and stored.

    ``files``: project_name, path, length, mtime; ``texts``: project_name, path, text and, where a text
    can't be read, error; ``folders``: project_name, those without files too.
    """
    spark.dataSource.register(PacketFolders)
    rows = stored(spark.read.format("packet_folders").options(**options).load(root), "folders")
    read = F.col("text").isNotNull() | F.col("error").isNotNull()
    return Listing(
        rows.where("path is not null").select("project_name", "path", "length", "mtime"),
        rows.where(read).select("project_name", "path", "text", "error"),
        rows.select("project_name").distinct(),
    )
