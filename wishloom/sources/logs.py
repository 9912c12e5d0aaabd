"""CSV logs under one stable header, and digests of whole files, as data sources.

A log is a folder: `_header.csv` holds the header, written once, and every
append adds `part-*.csv` files without one. Tasks write under a hidden name and
report it; the driver moves the files of a job into view when all of its tasks are
done, so a failed or repeated task leaves nothing that a reader sees. Files of a
stream are named by batch, so a batch that is committed again replaces itself.
`cat _header.csv part-*.csv` is the log as one file.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage)

HEADER_FILE = "_header.csv"
CHUNK = 1 << 22


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if not re.match(r"[a-zA-Z][\w+.-]*:", local) else fs.FileSystem.from_uri(path)


def as_csv(rows: Iterator) -> bytes:
    """Rows of text in the quoting of the log."""
    held = io.StringIO()
    csv.writer(held, lineterminator="\n").writerows(rows)
    return held.getvalue().encode()


@dataclass
class Staged(WriterCommitMessage):
    """A file that a task wrote under a hidden name, none for a task without rows."""

    path: str | None
    rows: int


class _Appender:
    """Writing, committing and undoing, shared by batch and stream."""

    def __init__(self, folder: str, header: list[str]):
        self.folder, self.header = folder, header

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = store_of(self.folder)
        store.create_dir(root, recursive=True)
        path, rows = f"{root}/_staged-{uuid.uuid4().hex}", 0
        with store.open_output_stream(path) as out:
            for batch in iterator:
                columns = [["" if v is None else v for v in c.cast(pa.string()).to_pylist()] for c in batch.columns]
                out.write(as_csv(zip(*columns, strict=True)))
                rows += batch.num_rows
        if not rows:
            store.delete_file(path)
            return Staged(None, 0)
        return Staged(path, rows)

    def publish(self, messages: list, stamp: str) -> None:
        store, root = store_of(self.folder)
        store.create_dir(root, recursive=True)
        if store.get_file_info(f"{root}/{HEADER_FILE}").type == fs.FileType.NotFound:
            mine = f"{root}/_header-{uuid.uuid4().hex}"
            with store.open_output_stream(mine) as out:
                out.write(as_csv([self.header]))
            store.move(mine, f"{root}/{HEADER_FILE}")
        for number, staged in enumerate(m for m in messages if m is not None and m.path):
            store.move(staged.path, f"{root}/part-{stamp}-{number:06d}.csv")

    def undo(self, messages: list) -> None:
        store, _ = store_of(self.folder)
        for staged in messages:
            if staged is not None and staged.path and store.get_file_info(staged.path).type != fs.FileType.NotFound:
                store.delete_file(staged.path)


class LogWriter(DataSourceArrowWriter):
    def __init__(self, appender: _Appender):
        self.appender = appender

    def write(self, iterator):
        return self.appender.write(iterator)

    def commit(self, messages):
        self.appender.publish(messages, f"{time.time_ns():020d}")

    def abort(self, messages):
        self.appender.undo(messages)


class LogStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, appender: _Appender):
        self.appender = appender

    def write(self, iterator):
        return self.appender.write(iterator)

    def commit(self, messages, batchId):
        self.appender.publish(messages, f"batch-{batchId:012d}")

    def abort(self, messages, batchId):
        self.appender.undo(messages)


class CsvLog(DataSource):
    """Appends rows of text. Options: path, and header as a JSON list, whose names may repeat."""

    @classmethod
    def name(cls):
        return "csvlog"

    def _appender(self, schema) -> _Appender:
        header = json.loads(self.options["header"])
        if len(header) != len(schema.fields):
            raise ValueError(f"The header has {len(header)} names, the rows have {len(schema.fields)} columns")
        return _Appender(self.options["path"], header)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("A log is only appended to")
        return LogWriter(self._appender(schema))

    def streamWriter(self, schema, overwrite):
        return LogStreamWriter(self._appender(schema))


def append_log(rows: DataFrame, path: str, header: list[str]) -> None:
    """Append rows, all columns as text, to the log at `path`."""
    rows.sparkSession.dataSource.register(CsvLog)
    rows.select(*[F.col(f"`{c}`").cast("string") for c in rows.columns]).write.format("csvlog").mode("append").option(
        "path", path).option("header", json.dumps(header)).save()


def stream_log(rows: DataFrame, path: str, header: list[str], checkpoint: str, available_now: bool = True):
    """The same for a stream; every batch is in the log once, whole. Returns the running query."""
    rows.sparkSession.dataSource.register(CsvLog)
    shown = rows.select(*[F.col(f"`{c}`").cast("string") for c in rows.columns])
    writer = shown.writeStream.format("csvlog").outputMode("append").option("path", path).option(
        "header", json.dumps(header)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_log(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of a log under names of the caller's, one per column; missing values are empty text."""
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = spark.read.schema(schema).option("header", False).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])


def log_header(path: str) -> list[str]:
    """The header of a log."""
    store, root = store_of(path)
    with store.open_input_stream(f"{root}/{HEADER_FILE}") as source:
        return next(csv.reader(io.StringIO(source.read().decode())))


@dataclass
class OneFile(InputPartition):
    path: str


class DigestReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        store, root = store_of(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            return [OneFile(root)]
        listed = store.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = [re.search(r"(^|/)[._][^/=]*(/|$)", f.path[len(root):]) for f in listed]
        return [OneFile(f.path) for f, h in zip(listed, hidden, strict=True) if f.type == fs.FileType.File and not h]

    def read(self, partition):
        store, _ = store_of(self.path)
        digest, length = hashlib.sha256(), 0
        with store.open_input_stream(partition.path) as source:
            while chunk := source.read(CHUNK):
                digest.update(chunk)
                length += len(chunk)
        yield partition.path, digest.hexdigest(), length


class FileDigest(DataSource):
    """(path, sha256, length) of every file under a path; a file of any size passes in chunks through one hash."""

    @classmethod
    def name(cls):
        return "filedigest"

    def schema(self):
        return "path string, sha256 string, length bigint"

    def reader(self, schema):
        return DigestReader(self.options["path"])


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FileDigest)
    return spark.read.format("filedigest").option("path", path).load()
