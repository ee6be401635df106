"""Changes that last: settings, folders, answers and the audit of them, as records of one versioned table.

A record is (key, entity, id, doc): an entity's row as JSON under the key ``entity:id``. What belongs together is one commit of
``sources.versions``: a folder with its project, its scan job and the mark that the library has been set up; an answer with the
cards that it cites. Who reads sees all of a change or nothing. Whole records before and after are kept by every commit, and the
audit log is read from them: nobody has to write it, and nothing can be changed without it.

Rows in, rows out: changes come as DataFrames of any size, and what they meet is joined with the records by key. Only settings, of which there
are a handful, are looked at by the driver, before anything is written.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.constants import SETTING_DEFAULTS, SPEECH_SIZES
from lodestar.operators.library import folder_name
from lodestar.sources import versions

SCHEMA = "key string, entity string, id string, doc string"
FOLDER = "id long, path string, display_name string, enabled boolean, include_subfolders boolean, file_types array<string>, last_scan_at timestamp"
PROJECT = "id long, folder_id long, parent_id long, name string"
FILE = "id long, folder_id long, rel_path string, sha256 string"
JOB = "id string, type string, folder_id long, status string"
CONVERSATION = "id long, title string, last_message long"
MESSAGE = "id long, conversation_id long, role string, content string, status string, model_id long, latency_ms long"
CARD = "id string, message_id long, marker int, chunk_id long, file_id long, file_name string, label string, page int, snippet string, cited boolean, sha256 string"
SETTING = "id string, value string, updated_by long"


class Refused(ValueError):
    """The change is not allowed; nothing has been written."""


def records(rows: DataFrame, entity: str, id_col: str = "id") -> DataFrame:
    """Rows of an entity as records."""
    of = F.col(id_col).cast("string")
    return rows.select(F.concat(F.lit(f"{entity}:"), of).alias("key"), F.lit(entity).alias("entity"), of.alias("id"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("doc"))


def put(spark: SparkSession, path: str, rows: Sequence[DataFrame], removed: DataFrame | None = None, **options) -> versions.Snapshot:
    """Write records and remove others (key) in one commit."""
    every = reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], SCHEMA)
    touched = every.select("key") if removed is None else every.select("key").unionByName(removed.select("key"))
    return versions.replace(spark, path, every, touched, key="key", feed=True, **options)


def held(spark: SparkSession, path: str, entity: str, schema: str, version: int | None = None) -> DataFrame:
    """An entity's rows, as of the newest version or of a given one."""
    found = versions.latest(spark, path, version)
    known = spark.createDataFrame([], SCHEMA) if found is None or found.generation() is None else found.rows(spark)
    return known.where(F.col("entity") == entity).select(F.from_json("doc", schema).alias("row")).select("row.*")


def _version(spark: SparkSession, path: str) -> int:
    found = versions.latest(spark, path)
    return 0 if found is None else found.version


def settings(spark: SparkSession, path: str) -> dict[str, str | None]:
    """All settings: what was set last, or the default."""
    return SETTING_DEFAULTS | {r.id: r.value for r in held(spark, path, "settings", SETTING).collect()}


def change_settings(spark: SparkSession, path: str, changes: dict[str, object], user: int | None = None) -> versions.Snapshot | None:
    """Set these (None leaves a setting as it is), if all are allowed: intervals of 30 to 86,400 seconds, sizes that exist."""
    new = {k: v for k, v in changes.items() if v is not None}
    interval = new.get("rescan_interval_seconds")
    if interval is not None and not 30 <= int(interval) <= 86_400:
        raise Refused("rescan_interval_seconds must be from 30 to 86400")
    if "whisper_model" in new and new["whisper_model"] not in SPEECH_SIZES:
        raise Refused(f"whisper_model must be one of {', '.join(SPEECH_SIZES)}")
    if not new:
        return versions.latest(spark, path)
    rows = spark.createDataFrame([(k, str(v), user) for k, v in new.items()], SETTING)
    return put(spark, path, [records(rows, "settings")])


def _set_up(spark: SparkSession, user: int | None) -> DataFrame:
    return records(spark.createDataFrame([("setup_completed", "true", user)], SETTING), "settings")


def _scans(folders: DataFrame) -> DataFrame:
    """One queued scan for each enabled folder: a second one falls onto the first."""
    rows = folders.where("enabled").select(F.concat(F.lit("scan:"), F.col("id").cast("string")).alias("id"), F.lit("scan_folder").alias("type"), F.col("id").alias("folder_id"), F.lit("queued").alias("status"))
    return records(rows, "job")


def create_folders(spark: SparkSession, path: str, new: DataFrame, user: int | None = None) -> DataFrame:
    """Folders (path, display_name, and what else FOLDER has) with all that comes with them; the folders that were created.

    A path that is in use is passed over, and of equal paths among the new ones all but the one whose name sorts first. A folder
    without a name has that of its path's last part. A folder's id is a hash of its path, so that no one counter is needed.
    """
    since = _version(spark, path)
    known = held(spark, path, "folder", FOLDER)
    first = Window.partitionBy("path").orderBy(F.col("display_name").asc_nulls_last())
    rows = new.withColumn("nth", F.row_number().over(first)).where("nth = 1").join(known.select("path"), "path", "left_anti")
    has = lambda c, default: F.coalesce(F.col(c), default) if c in new.columns else default
    rows = rows.select(
        F.abs(F.xxhash64("path")).alias("id"), "path", folder_name(F.col("display_name"), F.col("path")).alias("display_name"), has("enabled", F.lit(True)).alias("enabled"),
        has("include_subfolders", F.lit(True)).alias("include_subfolders"), has("file_types", F.lit(None).cast("array<string>")).alias("file_types"), F.lit(None).cast("timestamp").alias("last_scan_at"),
    )
    rows = versions.written(rows)
    if rows.isEmpty():
        return rows
    projects = rows.select("id", F.col("id").alias("folder_id"), F.lit(None).cast("long").alias("parent_id"), F.col("display_name").alias("name"))
    put(spark, path, [records(rows, "folder"), records(projects, "project"), _scans(rows), _set_up(spark, user)], since=since)
    return rows


def update_folders(spark: SparkSession, path: str, changes: DataFrame) -> DataFrame:
    """Change folders (id, and any of display_name, path, enabled, include_subfolders; null leaves it as it is).

    A name reaches the folder's root project. Another path removes the folder's file records and forgets its last scan; enabled
    folders get a scan. Returns the file records that went, whose chunks are to go from the chunk store.
    """
    since = _version(spark, path)
    fields = [c for c in ("display_name", "path", "enabled", "include_subfolders") if c in changes.columns]
    new = changes.select("id", *[F.col(c).alias(f"new_{c}") for c in fields])
    both = versions.written(held(spark, path, "folder", FOLDER).join(new, "id"))
    value = lambda c: F.coalesce(F.col(f"new_{c}"), F.col(c)) if c in fields else F.col(c)
    moved = (value("path") != F.col("path")) if "path" in fields else F.lit(False)
    after = both.select("id", *[value(c).alias(c) for c in ("path", "display_name", "enabled", "include_subfolders")], "file_types", F.when(~moved, F.col("last_scan_at")).alias("last_scan_at"))
    named = both.select(F.col("id").alias("folder_id"), value("display_name").alias("new_name")) if "display_name" in fields else None
    out = [records(after, "folder"), _scans(after)]
    if named is not None:
        roots = held(spark, path, "project", PROJECT).where("parent_id IS NULL").join(named, "folder_id").select("id", "folder_id", "parent_id", F.col("new_name").alias("name"))
        out.append(records(roots, "project"))
    gone = versions.written(held(spark, path, "file", FILE).join(both.where(moved).select(F.col("id").alias("folder_id")), "folder_id", "left_semi"))
    put(spark, path, out, records(gone, "file"), since=since)
    return gone


def save_answers(spark: SparkSession, path: str, answers: DataFrame, files: DataFrame) -> DataFrame:
    """Answers with their cards, frozen with each file's digest of now, in one commit; those that were saved.

    ``answers`` has MESSAGE's columns (role apart) and cards: array of (marker, chunk_id, file_id, file_name, label, page, snippet,
    cited). An answer of a conversation that is gone meanwhile is passed over; the conversation's last message follows.
    """
    since = _version(spark, path)
    there = held(spark, path, "conversation", CONVERSATION)
    saved = versions.written(answers.join(there.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi"))
    messages = saved.select("id", "conversation_id", F.lit("assistant").alias("role"), "content", "status", "model_id", "latency_ms")
    cards = saved.select(F.col("id").alias("message_id"), F.explode("cards").alias("c")).select("message_id", "c.*").join(files.select(F.col("id").alias("file_id"), "sha256"), "file_id", "left")
    cards = cards.select(F.concat_ws("/", F.col("message_id").cast("string"), F.col("marker").cast("string")).alias("id"), "message_id", "marker", "chunk_id", "file_id", "file_name", "label", "page", "snippet", "cited", "sha256")
    last = saved.groupBy(F.col("conversation_id").alias("id")).agg(F.max("id").alias("last"))
    touched = there.join(last, "id").select("id", "title", F.greatest("last_message", "last").alias("last_message"))
    put(spark, path, [records(messages, "message"), records(cards, "card"), records(touched, "conversation")], since=since)
    return messages


def audit(spark: SparkSession, path: str, after: int = 0, until: int | None = None) -> DataFrame:
    """(version, action, entity, entity_id, before, after) of every record that a commit changed, as JSON."""
    feed = versions.change_feed(spark, path, after, until)
    action = F.when(F.col("before").isNull(), "create").when(F.col("after").isNull(), "delete").otherwise("update")
    doc = lambda c: F.get_json_object(F.col(c)[0], "$.doc")
    entity: Column = F.substring_index("key", ":", 1)
    return feed.select("version", action.alias("action"), entity.alias("entity"), F.expr("substring(key, length(substring_index(key, ':', 1)) + 2)").alias("entity_id"), doc("before").alias("before"), doc("after").alias("after"))
