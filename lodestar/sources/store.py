"""Stores: chunks replaced by file, embeddings kept by content, versions and models that force a new index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.constants import INDEX_VERSION
from lodestar.sources import versions

#: Buckets of a new store: a bucket is one writer's work, so a large corpus asks for more (``swap_chunks``, ``rebucketed``).
BUCKETS = 64


def swap_chunks(spark: SparkSession, path: str, chunks: DataFrame, touched: DataFrame, buckets: int = BUCKETS, *, model: str = versions.FIRST, index_version: int = INDEX_VERSION, **options) -> versions.Snapshot:
    """Replace all chunks of the ``touched`` files (file_id) by ``chunks``, as one commit of a versioned table.

    Only the buckets of touched files are written. Every chunk carries the index version that made it; chunks of each
    model are a generation of their own. ``options`` are those of ``versions.replace``.
    """
    rows = chunks.withColumn("index_version", F.lit(index_version))
    return versions.replace(spark, path, rows, touched, key="file_id", buckets=buckets, generation=model, **options)


def searched_chunks(spark: SparkSession, path: str, model: str = versions.FIRST) -> DataFrame | None:
    """The chunks that a question encoded by ``model`` can meet: its generation's, whatever index version made them.

    None where the store has no chunks of that model: vectors of another one say nothing to it.
    """
    found = versions.latest(spark, path)
    return None if found is None or found.generation(model) is None else found.rows(spark, model)


def files_to_index(spark: SparkSession, path: str, files: DataFrame, model: str = versions.FIRST, index_version: int = INDEX_VERSION) -> DataFrame:
    """The files (file_id) of which the model's generation has no chunks, or chunks of another index version."""
    made = searched_chunks(spark, path, model)
    if made is None:
        return files
    return files.join(made.where(F.col("index_version") == index_version).select("file_id").distinct(), "file_id", "left_anti")


def switch_model(spark: SparkSession, path: str, model: str, *, keep_old: bool = False) -> bool:
    """Search by another model from now on; false if it is searched already.

    Its generation is what has been filled so far, or empty. The old one's chunks are no longer searched and go, unless
    ``keep_old`` leaves them for switching back.
    """
    base = versions.latest(spark, path)
    if base is None:
        raise KeyError(f"no store at {path}")
    if base.searched == model and base.generation(model) is not None:
        return False
    if base.generation(model) is None:
        old = next(iter(base.doc["generations"].values()))

        def empty(doc: dict) -> dict:
            doc["generations"].setdefault(model, {"parts": {}, "meta": {}, "schema": old["schema"]})
            return doc | {"changed": {}, "changes": None}

        while versions.commit(spark, versions.latest(spark, path), empty) is None:
            pass
    versions.promote(spark, path, model, drop_others=not keep_old)
    return True


def rebucketed(spark: SparkSession, path: str, to: str, buckets: int) -> None:
    """The newest snapshot of the store at ``path`` written anew to ``to`` with another number of buckets."""
    base = versions.latest(spark, path)
    for name, known in base.doc["generations"].items():
        rows = base.rows(spark, name)
        versions.replace(spark, to, rows, rows.select(base.doc["key"]), key=base.doc["key"], buckets=buckets, generation=name, meta=known["meta"])
    if versions.latest(spark, to) is not None and base.generation() is not None:
        versions.promote(spark, to, base.searched)


def text_hash(model: str, passage: str = "passage"):
    return F.sha2(F.concat(F.lit(model), F.lit("\x00"), F.col(passage)), 256)


def embed_missing(passages: DataFrame, cache: DataFrame, model: str, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(text_hash, …) of the passages that the cache lacks: each distinct one encoded once, to be appended to it."""
    new = passages.select(text_hash(model).alias("text_hash"), "passage").dropDuplicates(["text_hash"])
    return encode(new.join(cache.select("text_hash"), "text_hash", "left_anti"))


def outdated(manifest: DataFrame, model: str) -> DataFrame:
    """Files whose index was made by another version or model."""
    return manifest.where((F.col("index_version") != INDEX_VERSION) | (F.col("model") != model))
