"""A folder kept indexed by a stream: each batch scans, compares, extracts, chunks and swaps what has changed.

A batch brings folders to scan (``schedule.scan_jobs``, or a tick). What is in the folder is compared with the records of its files;
files whose size or time of change differ are read; those whose content is another than what the chunk store holds are chunked
and swapped in, removed ones swapped out, as one commit of the store; then the records follow, as one commit of their table. Both carry
the number of the batch.

What decides is the store's own digests. So a batch that died between the two commits, or in one of them, is simply run again: what
is in already is not written again, and the records come to say what the store holds. A touched file with equal content changes its
record only. Files that cannot be decoded or have no text are recorded without chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.constants import INDEX_VERSION
from lodestar.lineage import written
from lodestar.operators import mutations
from lodestar.operators.chunking import file_chunks
from lodestar.sources import store, versions
from lodestar.sources.folders import list_folder
from lodestar.sources.segments import markdown_sections, text_windows

RECORD = "id long, folder string, rel_path string, size_bytes long, mtime timestamp, sha256 string, status string"


def file_id(folder: str, rel_path: Column) -> Column:
    return F.abs(F.xxhash64(F.lit(folder), rel_path))


def segments_of(texts: DataFrame) -> DataFrame:
    """Texts (file_id, file_name, sha256, text) of text and Markdown files -> their segments, as ``file_chunks`` takes them."""
    plain = F.lower("file_name").endswith(".txt")
    none = lambda t: F.lit(None).cast(t)
    keep = ["file_id", "file_name", "line_start", "line_end", "segment"]
    windows = text_windows(texts.where(plain)).select(*keep, F.lit("lines").alias("loc_type"), none("string").alias("heading"))
    sections = markdown_sections(texts.where(~plain)).select(*keep, "loc_type", "heading")
    return windows.unionByName(sections).withColumn("place", F.col("line_start")).withColumn("page", none("int"))


def chunks_of(texts: DataFrame, model: str) -> DataFrame:
    """The chunks of texts, each with its file's digest; a file without a chunk is one row without text, so that it is known."""
    digests = texts.select("file_id", "sha256")
    made = file_chunks(segments_of(texts), model).join(digests, "file_id", "right")
    return made.select("file_id", "sha256", F.coalesce("ordinal", F.lit(0)).cast("int").alias("ordinal"), "label", "header", "text", F.col("tokens").cast("int").alias("tokens"))


def index_folder(spark: SparkSession, folder: str, at: str, read: Callable[[DataFrame], DataFrame], model: str, *, batch: tuple[str, int] | None = None, buckets: int = store.BUCKETS, index_version: int = INDEX_VERSION) -> dict[str, int]:
    """Bring the chunk store and the file records under ``at`` up to what is in the folder now; how many files were written and removed.

    ``read`` gives (path, text, sha256) of files (path): ``sources.folders.texts_of``, or an extractor's.
    """
    chunk_store, records = f"{at}/chunks", f"{at}/records"
    found = list_folder(spark, folder).where("kind = 'text'").withColumn("file_id", file_id(folder, F.col("rel_path")))
    known = mutations.held(spark, records, "file", RECORD).where(F.col("folder") == folder)
    held = store.searched_chunks(spark, chunk_store, model)
    held = spark.createDataFrame([], "file_id long, sha256 string, index_version int") if held is None else held.select("file_id", "sha256", "index_version")
    held = held.distinct()
    both = found.join(known.where("status <> 'deleted'").select(F.col("id").alias("file_id"), F.col("size_bytes").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("sha256").alias("old_sha")), "file_id", "left").join(held.select("file_id", F.col("sha256").alias("held_sha"), "index_version"), "file_id", "left")
    as_before = (F.col("size_bytes") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime")) & (F.col("held_sha") == F.col("old_sha")) & (F.col("index_version") == index_version)
    differing = written(both.where(~F.coalesce(as_before, F.lit(False))))
    if differing.isEmpty():
        texts = spark.createDataFrame([], "path string, text string, sha256 string")
    else:
        texts = read(differing.select("path"))
    texts = written(texts.join(differing.select("path", "file_id", "file_name", "rel_path", "size_bytes", "mtime", "held_sha", "index_version"), "path"))
    new = texts.where(~(F.col("sha256").eqNullSafe(F.col("held_sha")) & (F.col("index_version") == index_version)))
    gone = written(known.where("status <> 'deleted'").join(found.select(F.col("file_id").alias("id")), "id", "left_anti"))
    touched = written(new.select("file_id").unionByName(gone.select(F.col("id").alias("file_id")).join(held.select("file_id"), "file_id", "left_semi")))
    n = {"indexed": new.count(), "removed": gone.count()}
    if not touched.isEmpty():
        store.swap_chunks(spark, chunk_store, chunks_of(new.select("file_id", "file_name", "sha256", "text"), model), touched, buckets, model=model, index_version=index_version)
    rows = texts.select(F.col("file_id").alias("id"), F.lit(folder).alias("folder"), "rel_path", "size_bytes", "mtime", "sha256", F.lit("indexed").alias("status"))
    rows = rows.unionByName(gone.select("id", "folder", "rel_path", "size_bytes", "mtime", F.lit(None).cast("string").alias("sha256"), F.lit("deleted").alias("status")))
    if not rows.isEmpty() or batch is not None and (versions.latest(spark, records) or versions.new(records, "key", 1)).batch(batch[0]) < batch[1]:
        mutations.put(spark, records, [mutations.records(rows, "file")], batch=batch, repeat=True)
    return n


def keep_indexed(jobs: DataFrame, at: str, checkpoint: str, read: Callable[[DataFrame], DataFrame], model: str, *, name: str = "indexing", **options) -> StreamingQuery:
    """Index the folders that the stream's rows name (folder), batch by batch; what there is now, then the query ends."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        for row in batch.select("folder").distinct().toLocalIterator():  # folders are configured by hand
            index_folder(spark, row["folder"], at, read, model, batch=(f"{name}:{row['folder']}", number), **options)

    return jobs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
