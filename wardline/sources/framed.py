"""Logs of Content-Length frames as a data source, for batches and streams: ``spark.read.format("frames").load(path)`` after ``register``.

A file is cut into ranges of ``splitBytes``, a task each. A range's task finds the first header in it and reads the frames that start in it to their end, also
beyond the range. A header (its length, digits, and a line end) can't stand in JSON, where line ends in strings are escaped, so that all tasks see
the same frames. What is no frame is set aside, and the next header is where reading goes on: no bad frame ends a file.

Files are reached as pyarrow's file systems reach them (a path, or a URI of theirs). For paths that only Spark reads, ``messages.framed`` gets whole
files through Spark and cuts them alike.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, offset long, body string, error string"
#: A header line that says how long a body is, with those behind it and the blank line; and the lines that may stand before it.
_HEADER = re.compile(rb"content-length:[ \t]*(\d{1,18})[ \t]*\r?\n(?:[A-Za-z0-9-]+:[^\r\n]*\r?\n)*\r?\n", re.IGNORECASE)
_BEFORE = re.compile(rb"(?:[A-Za-z0-9-]+:[^\r\n]*\r?\n)+\Z")
SPLIT = 32 << 20
#: Bytes that are looked through at a time, the most that a header takes, what is looked through first, and what is read at a time.
STEP, LONGEST, FIRST, AHEAD = 1 << 20, 1 << 16, 1 << 12, 1 << 22


class _Window:
    """A file read piece by piece."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def near(self, a: int, n: int) -> tuple[bytes, int, int]:
        """What is read, and from where to where in it up to ``n`` bytes from ``a`` on stand."""
        n = min(n, self.size - a)
        if n <= 0:
            return b"", 0, 0
        if not (self.at <= a and a + n <= self.at + len(self.data)):
            self.file.seek(a)
            self.at, self.data = a, self.file.read(max(n, AHEAD))
        return self.data, a - self.at, min(a - self.at + n, len(self.data))

    def get(self, a: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``a`` on."""
        data, lo, hi = self.near(a, n)
        return data[lo:hi]


def _next_header(w: _Window, at: int, end: int):
    """Start, end of the header, and length of the body, of the first header that starts from ``at`` on and before ``end``."""
    step = FIRST  # most often, it is right here
    while at < end:
        data, lo, hi = w.near(at, step + LONGEST)
        m = _HEADER.search(data, lo, hi)
        if m and (m.start() - lo < step or hi - lo < step + LONGEST):
            begin = at + m.start() - lo
            return (begin, begin + m.end() - m.start(), int(m.group(1))) if begin < end else None
        if hi - lo < step + LONGEST:
            return None
        at, step = at + step, STEP
    return None


def _is_json(body: bytes) -> bool:
    try:
        json.loads(body)
    except RecursionError:
        return True
    except ValueError:
        return False
    return True


def frames(w: _Window, start: int, end: int) -> Iterator[tuple[int, str, str | None]]:
    """offset, body and error (null: none) of the frames whose header starts from ``start`` on and before ``end``, and of what stands behind each up to the
    next header and is no frame, in pieces. A frame's offset is that of its Content-Length."""
    at, found, owned = start, _next_header(w, start, w.size if start == 0 else end), start == 0
    while True:
        upto = found[0] if found else w.size
        for a in range(at, upto, STEP) if owned else ():
            piece = w.get(a, min(STEP, upto - a))
            if found and a + len(piece) == upto:
                piece = _BEFORE.sub(b"", piece)
            if piece.strip():
                yield a, piece.decode("utf-8", "replace"), "no frame"
        if not found or found[0] >= end:
            return
        begin, head, n = found
        body = w.get(head, n)
        at, error = head + len(body), None
        if len(body) < n or not _is_json(body):
            error = "cut short" if len(body) < n else "no JSON"
            if inner := _HEADER.search(body):  # the next header is within
                body, error = body[: inner.start()], "wrong length"
                at = head + inner.start()
                body = _BEFORE.sub(b"", body)
        yield begin, body.decode("utf-8", "replace"), error
        owned, found = True, _next_header(w, at, w.size)


def complete(w: _Window, start: int) -> int:
    """Where the last frame that is whole ends: what is behind it may still be written."""
    back = STEP
    while True:
        at, last = max(start, w.size - back), None
        begin = at
        while found := _next_header(w, at, w.size):
            last, at = found, found[1]
        if last:
            return last[1] + last[2] if last[1] + last[2] <= w.size else last[0]
        if begin == start:
            return start
        back *= 8


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> dict[str, int]:
    """The files at a path, or right in a folder, and their sizes; hidden ones are left out."""
    from pyarrow import fs

    system, at = _filesystem(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at))
    return {x.path: x.size for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))}


def _window(path: str, name: str) -> _Window:
    file = _filesystem(path)[0].open_input_file(name)
    return _Window(file, file.size())


def _ranges(name: str, start: int, end: int, split: int) -> list[Range]:
    return [Range(name, a, min(a + split, end)) for a in range(start, end, split)]


class _Reading:
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT))

    def rows(self, part: Range | None):
        if part is None or not part.path:  # there are no files
            return
        w = _window(self.path, part.path)
        with w.file:
            for offset, body, error in frames(w, part.start, part.end):
                yield part.path, offset, body, error


class FramesReader(_Reading, DataSourceReader):
    def partitions(self):
        return [r for name, size in sorted(_files(self.path).items()) for r in _ranges(name, 0, size, self.split)]

    def read(self, partition):
        return self.rows(partition)


class FramesStreamReader(_Reading, DataSourceStreamReader):
    """Offsets are how far each file has been read, always up to the end of a whole frame; files grow and are added."""

    def __init__(self, options):
        super().__init__(options)
        self.reached = {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        for name, size in _files(self.path).items():
            done = self.reached.get(name, 0)
            if size > done:
                w = _window(self.path, name)
                with w.file:
                    self.reached[name] = complete(w, done)
        return {name: at for name, at in self.reached.items() if at}

    def partitions(self, start, end):
        self.reached = {**end, **self.reached}
        return [r for name, at in sorted(end.items()) for r in _ranges(name, start.get(name, 0), at, self.split)] or [Range("", 0, 0)]

    def read(self, partition):
        return self.rows(partition)


class Frames(DataSource):
    @classmethod
    def name(cls):
        return "frames"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FramesReader(self.options)

    def streamReader(self, schema):
        return FramesStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Frames)
