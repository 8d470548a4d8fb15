"""A sink of lines that holds each batch once: ``writeStream.format("lines_once")`` after ``register``.

A task writes its lines to a new file and tells its name; a commit writes the batch's list of files in one step, under the batch's number. A batch that is
committed again, after a restart that didn't know of the first time, finds its list and leaves its new files out. Readers take the files that are
listed and no others, so that what a killed task or batch has left is never seen. Files are written as pyarrow's file systems write them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

LISTS = "_batches"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    name: str
    lines: int


class LinesWriter(DataSourceStreamWriter):
    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator: Iterator) -> Written:
        system, at = _filesystem(self.path)
        system.create_dir(at, recursive=True)
        name, n = f"{uuid.uuid4().hex}.txt", 0
        with system.open_output_stream(f"{at}/{name}") as out:
            for row in iterator:
                out.write((row[0] or "").replace("\n", "\\n").encode() + b"\n")
                n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        from pyarrow import fs

        system, at = _filesystem(self.path)
        done = f"{at}/{LISTS}/{batchId:012d}"
        system.create_dir(f"{at}/{LISTS}", recursive=True)
        if system.get_file_info(done).type != fs.FileType.NotFound:
            self.abort(messages, batchId)  # the batch is there already
            return
        new = f"{done}.{uuid.uuid4().hex}.new"
        with system.open_output_stream(new) as out:
            out.write(json.dumps([m.name for m in messages if m and m.lines]).encode())
        system.move(new, done)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        system, at = _filesystem(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{at}/{m.name}")


class LinesOnce(DataSource):
    """One column of text: a line a row; line ends in it are written as a backslash and an n."""

    @classmethod
    def name(cls):
        return "lines_once"

    def schema(self):
        return "value string"

    def streamWriter(self, schema, overwrite):
        if len(schema.fields) != 1 or schema.fields[0].dataType.typeName() != "string":
            raise ValueError("lines are one column of text")
        return LinesWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LinesOnce)


def read(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of all committed batches. The lists are read by the driver: a name for each task of each batch."""
    from pyarrow import fs

    system, at = _filesystem(path)
    found = []
    for x in system.get_file_info(fs.FileSelector(f"{at}/{LISTS}", allow_not_found=True)):
        if not x.base_name.endswith(".new"):
            with system.open_input_file(x.path) as f:
                found += [f"{path.rstrip('/')}/{name}" for name in json.loads(f.read())]
    return spark.read.text(found) if found else spark.createDataFrame([], "value string")
