"""Reading folders of documents: through ``folder_source``, or Spark's binary-file source where only Spark reads the store."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.constants import HIDDEN_DIR_PREFIXES
from lodestar.functions.files import allowed_extensions, extension, ignored_name, kind_of
from lodestar.sources.folder_source import opened, registered, supported


def _by_spark(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    """The same columns from the binary-file source, which leaves out names that begin with an underscore."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true" if recursive else "false").load(path)
    base = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", ""), "^" + "".join(f"\\{c}" if not c.isalnum() and c != "/" else c for c in base) + "/?", "")
    return found.select("path", rel.alias("rel_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), "content")


def _visible(rel_path: Column) -> Column:
    """Neither the file's name nor a folder above it is one to be passed over."""
    parts = F.split(rel_path, "/")
    hidden = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda d: F.substring(d, 1, 1).isin(*HIDDEN_DIR_PREFIXES))
    return ~ignored_name(F.element_at(parts, -1)) & ~hidden


def list_folder(spark: SparkSession, path: str, *, recursive: bool = True, groups: list[str] | None = None) -> DataFrame:
    """(path, rel_path, file_name, size_bytes, mtime, kind) of supported files; only metadata is read."""
    if supported(path):
        found = registered(spark).read.format("folder").option("recursive", str(recursive)).load(path).drop("content")
    else:
        found = _by_spark(spark, path, recursive).drop("content")
    found = found.withColumn("file_name", F.element_at(F.split("rel_path", "/"), -1))
    kept = found.where(_visible(F.col("rel_path")) & extension(F.col("file_name")).isin(*allowed_extensions(groups)))
    return kept.select("path", "rel_path", "file_name", "size_bytes", "mtime", kind_of(F.col("file_name")).alias("kind"))


def decode(raw: bytes) -> str:
    """Text by its byte-order mark, else UTF-8, else Windows-1252, else Latin-1."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", errors="replace")
    for name in ("utf-8-sig", "cp1252"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(b.as_py()) for b in batch.column(1)], pa.string()), batch.column(2)], names=["path", "text", "sha256"])


def read_texts(spark: SparkSession, path: str, *, recursive: bool = True) -> DataFrame:
    """(path, text, sha256) of the text and Markdown files of a folder."""
    if supported(path):
        files = registered(spark).read.format("folder").option("content", "true").option("recursive", str(recursive)).load(path)
    else:
        files = _by_spark(spark, path, recursive)
    texts = files.where(_visible(F.col("rel_path")) & (kind_of(F.element_at(F.split("rel_path", "/"), -1)) == "text"))
    return texts.select("path", "content", F.sha2("content", 256).alias("sha256")).mapInArrow(_decode, "path string, text string, sha256 string")


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, at = opened(path)
            try:
                with fs.open_input_stream(at) as stream:
                    raw = stream.read()
            except FileNotFoundError:
                continue
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([decode(raw)]), pa.array([hashlib.sha256(raw).hexdigest()])], names=["path", "text", "sha256"])


def texts_of(files: DataFrame) -> DataFrame:
    """(path, text, sha256) of files (path) that have been listed, read where their rows are, one at a time; those that are gone are left out."""
    return files.select("path").mapInArrow(_open, "path string, text string, sha256 string")
