"""Folders as a data source: every file whatever its name, listed in one pass and read one at a time.

``spark.read.format("folder").load(path)`` has one row a file: path, rel_path, size_bytes, mtime, and content (null unless the option
``content`` is true). Spark's own binary-file source leaves out names that begin with an underscore; this one leaves out nothing.
A listing is planned into partitions of ``bytes`` (128 MiB) and ``files`` (1,000) at most, a larger file being one by itself; contents come as batches of one
file, so that a worker holds one at a time.

As a stream, a file comes when it is new or its time of change is: offsets are (mtime, path), and a batch is what lies after one and up to the
next. What comes into the folder with an older time than what was there is not seen; a scan of the folder finds it.

File systems are those of ``pyarrow.fs``: local or mounted folders, HDFS, S3, Google Cloud; ``supported`` tells.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, rel_path string, size_bytes long, mtime timestamp, content binary"
_ARROW = pa.schema([("path", pa.string()), ("rel_path", pa.string()), ("size_bytes", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("content", pa.binary())])
BYTES, FILES = 128 << 20, 1_000


def supported(path: str) -> bool:
    scheme, found, _ = path.partition("://")
    return path.startswith("/") or path.startswith("file:") or bool(found) and scheme in ("hdfs", "s3", "gs")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class File:
    path: str
    rel_path: str
    size: int
    mtime_ns: int

    @property
    def place(self) -> tuple[int, str]:
        return self.mtime_ns, self.rel_path


@dataclass
class Files(InputPartition):
    files: list[File]


def listed(folder: str, recursive: bool = True) -> list[File]:
    """All files of a folder, in order of their path."""
    fs, at = opened(folder)
    found = fs.get_file_info(pafs.FileSelector(at, recursive=recursive))
    base = at.rstrip("/") + "/"
    return sorted((File(f.path, f.path.removeprefix(base), f.size, f.mtime_ns) for f in found if f.type == pafs.FileType.File), key=lambda f: f.rel_path)


def planned(files: list[File], most_bytes: int = BYTES, most_files: int = FILES) -> list[Files]:
    """Runs of files that stay within both bounds; a file beyond them is alone."""
    out: list[Files] = []
    size = 0
    for f in files:
        if not out or size + f.size > most_bytes or len(out[-1].files) >= most_files:
            out.append(Files([]))
            size = 0
        out[-1].files.append(f)
        size += f.size
    return out


def rows(folder: str, files: list[File], content: bool) -> Iterator[pa.RecordBatch]:
    """Batches of one file with its content, or of all without; a file that is gone meanwhile is passed over."""
    fs, _ = opened(folder)
    groups = [[f] for f in files] if content else [files] if files else []
    for group in groups:
        data: list[bytes | None] = [None] * len(group)
        if content:
            try:
                with fs.open_input_stream(group[0].path) as stream:
                    data = [stream.read()]
            except FileNotFoundError:
                continue
        columns = [[f.path for f in group], [f.rel_path for f in group], [f.size for f in group], [dt.datetime.fromtimestamp(f.mtime_ns // 1_000 / 1e6, dt.timezone.utc) for f in group], data]
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW, strict=True)], schema=_ARROW)


class _Options:
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.content = options.get("content", "false").lower() == "true"
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.bytes, self.files = int(options.get("bytes", BYTES)), int(options.get("files", FILES))


class _Reader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Files]:
        o = self.options
        return planned(listed(o.folder, o.recursive), o.bytes, o.files) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return rows(self.options.folder, partition.files, self.options.content)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: _Options):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"mtime_ns": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        last = max((f.place for f in listed(self.options.folder, self.options.recursive)), default=(-1, ""))
        return {"mtime_ns": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, until = (start["mtime_ns"], start["path"]), (end["mtime_ns"], end["path"])
        files = [f for f in listed(self.options.folder, self.options.recursive) if after < f.place <= until]
        return planned(files, self.options.bytes, self.options.files) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return rows(self.options.folder, partition.files, self.options.content)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(_Options(self.options))

    def streamReader(self, schema) -> _StreamReader:  # noqa: N802
        return _StreamReader(_Options(self.options))


def registered(spark: SparkSession) -> SparkSession:
    """The session, with the source known to it."""
    spark.dataSource.register(FolderSource)
    return spark
