"""Stream sinks that write files, each row once: what a batch wrote gets its names when the batch commits."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from tracelake.sources.splits import filesystem

#: Folder, beside the files, with a marker for each batch that is complete.
COMMITTED = "_committed"


@dataclass
class _Part(WriterCommitMessage):
    temporary: str | None  # None of a task without rows, which leaves no file; Spark wants a message of it too
    number: int


def _files(messages: list[_Part | None]) -> list[_Part]:
    return [m for m in messages if m is not None and m.temporary is not None]


class BatchFiles(DataSourceStreamWriter):
    """A file a task and batch, named by both.

    Tasks write hidden files.  When a batch commits, those get their names and a marker is written.  A batch that is
    run again after a crash finds the marker and drops what it wrote anew, or finds names without marker, left by a
    commit that broke off, and replaces them.  Tasks that are repeated write other hidden files; only those of the
    attempt that Spark took over are named.
    """

    def __init__(self, path: str, ending: str, encode: Callable[[object, Iterator], None]) -> None:
        self.path, self.ending, self.encode = path.rstrip("/"), ending, encode

    def write(self, iterator):
        from pyspark import TaskContext

        system, at = filesystem(self.path)
        number = TaskContext.get().partitionId()
        first = next(iterator, None)
        if first is None:
            return _Part(None, number)

        def rows():
            yield first
            yield from iterator

        system.create_dir(at, recursive=True)
        temporary = f"{at}/.part-{number:05d}-{uuid.uuid4().hex}"
        with system.open_output_stream(temporary, compression=None) as stream:
            self.encode(stream, rows())
        return _Part(temporary, number)

    def commit(self, messages, batchId):
        from pyarrow import fs

        system, at = filesystem(self.path)
        marker, prefix = f"{at}/{COMMITTED}/{batchId}", f"batch-{batchId:010d}-"
        parts = _files(messages)
        if system.get_file_info(marker).type != fs.FileType.NotFound:
            self._drop(parts)
            return
        for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f.base_name.startswith(prefix):
                system.delete_file(f.path)
        for m in parts:
            system.move(m.temporary, f"{at}/{prefix}{m.number:05d}{self.ending}")
        system.create_dir(f"{at}/{COMMITTED}", recursive=True)
        with system.open_output_stream(marker, compression=None):
            pass

    def abort(self, messages, batchId):
        self._drop(_files(messages))

    def _drop(self, parts: list[_Part]) -> None:
        from pyarrow import fs

        system, _ = filesystem(self.path)
        for m in parts:
            if system.get_file_info(m.temporary).type != fs.FileType.NotFound:
                system.delete_file(m.temporary)


def _encode_lines(stream, rows) -> None:
    for r in rows:
        stream.write(r[0].encode() + b"\n")


class LineSink(DataSource):
    """``writeStream.format("lines")``: a string column as lines, each once."""

    @classmethod
    def name(cls):
        return "lines"

    def streamWriter(self, schema, overwrite):
        if [f.dataType.typeName() for f in schema.fields] != ["string"]:
            raise ValueError("lines are written of one string column")
        return BatchFiles(self.options["path"], self.options.get("ending", ".log"), _encode_lines)


def write_stream(rows: DataFrame, kind: str, path: str, checkpoint: str, options: dict | None = None, **trigger):
    """Starts a query that appends to a folder by a sink of this module."""
    writer = rows.writeStream.format(kind).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    for name, value in (options or {}).items():
        writer = writer.option(name, value)
    return (writer.trigger(**trigger) if trigger else writer).start()


def register_lines(spark: SparkSession) -> None:
    spark.dataSource.register(LineSink)
