"""Watching folders: new files as a stream, bursts of events as one scan. One waiting job a key is in ``schedule``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.constants import DEBOUNCE_SECONDS, POLL_SECONDS
from lodestar.functions.files import ignored_name, kind_of
from lodestar.sources.folder_source import registered


def new_files(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files as they appear in a folder or change, without their contents."""
    stream = registered(spark).readStream.format("folder").load(folder)
    name = F.element_at(F.split("rel_path", "/"), -1)
    found = stream.select("path", "mtime", "size_bytes", name.alias("file_name"), kind_of(name).alias("kind"))
    return found.where(~ignored_name(F.col("file_name")) & F.col("kind").isNotNull())


def scans(events: DataFrame, *, gap: int = DEBOUNCE_SECONDS, late: str = "1 minute") -> DataFrame:
    """One row per burst of events (folder_id, seen_at): a scan once nothing has happened for the gap."""
    bursts = events.withWatermark("seen_at", late).groupBy("folder_id", F.session_window("seen_at", f"{gap} seconds").alias("w"))
    return bursts.agg(F.count("*").alias("n_events")).select("folder_id", F.col("w.end").alias("due_at"), "n_events")


def run(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Hand every batch to ``handle``: all that is there now, or every POLL_SECONDS."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{POLL_SECONDS} seconds")).start()
