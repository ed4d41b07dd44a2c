"""News records as JSON lines in a folder, as a table and as a stream.

Each line is one object with ``id``, ``time`` (ISO 8601) and ``currency``, and perhaps ``title`` and ``content``. A line that
is no such object is a row as well, with nulls and an ``error``, so that it is counted and not lost. Files are read in
parts of bounded size, cut at line ends. A stream goes by file names: new files must sort behind the old ones, and a file
does not change once it is there; an offset is a name, so a replay from it reads the same files again.

Register with ``spark.dataSource.register(NewsLines)`` and read with format ``news_lines`` and the option ``path``.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, at long, id string, time timestamp, currency string, title string, content string, error string"
PART_BYTES = 32 << 20


@dataclass
class Part(InputPartition):
    """The lines of a file that begin within a range of bytes."""

    path: str
    start: int
    stop: int


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """Any store that Arrow opens, and the folder in it."""
    return fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def _files(folder: str) -> list[fs.FileInfo]:
    """The files of a folder, by name; hidden ones are left out."""
    store, place = _store(folder)
    found = store.get_file_info(fs.FileSelector(place, recursive=False))
    return sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)


def _parts(files: list[fs.FileInfo], size: int) -> list[Part]:
    return [Part(f.path, start, min(start + size, f.size)) for f in files for start in range(0, f.size, size)]


def _event(line: bytes) -> tuple:
    """id, time, currency, title, content, error of a line."""
    try:
        record = json.loads(line)
        time = datetime.fromisoformat(record["time"])
        time = time if time.tzinfo else time.replace(tzinfo=timezone.utc)
        texts = [None if record.get(c) is None else str(record[c]) for c in ("title", "content")]
        return str(record["id"]), time, str(record["currency"]), *texts, None
    except (ValueError, KeyError, TypeError, AttributeError) as wrong:
        return None, None, None, None, None, f"{type(wrong).__name__}: {wrong}"


class _Lines:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.size = options["path"], int(options.get("part_bytes", PART_BYTES))

    def read(self, part: Part) -> Iterator[tuple]:
        with _store(self.folder)[0].open_input_file(part.path) as file, io.BufferedReader(file) as source:
            at = part.start
            if at:  # the line that crosses the start belongs to the part before
                source.seek(at - 1)
                at += len(source.readline()) - 1
            while at < part.stop and (line := source.readline()):
                if line.strip():
                    yield part.path, at, *_event(line)
                at += len(line)


class _Batch(_Lines, DataSourceReader):
    def partitions(self) -> list[Part]:
        return _parts(_files(self.folder), self.size)


class _Stream(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        files = _files(self.folder)
        return {"after": files[-1].base_name if files else ""}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return _parts([f for f in _files(self.folder) if start["after"] < f.base_name <= end["after"]], self.size)

    def commit(self, end: dict) -> None:
        pass


class NewsLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "news_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Batch:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> _Stream:
        return _Stream(self.options)
