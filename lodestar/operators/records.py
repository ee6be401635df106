"""Files and conversations over their lives: what events and deletions leave, sessions, roots of paths, frozen cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.constants import SESSION_DAYS

SETTERS = {"requeued": "queued", "removed": "deleted"}
OUTCOMES = ("indexed", "failed")


def after_events(files: DataFrame, events: DataFrame) -> DataFrame:
    """(id, status) of files after events (file_id, happened_at, id, event), in the order of (happened_at, id).

    ``requeued`` and ``removed`` hold in any state; ``claimed`` moves a queued file to processing, ``indexed`` and ``failed``
    end processing; other events change nothing. So a file's last setting event, the first claim after it and the first
    outcome after that say it all: three aggregations that combine before the shuffle, however many events a file has.
    """
    stamp = F.struct("happened_at", "id")
    rows = events.select("file_id", "event", stamp.alias("stamp"))
    setting = F.when(F.col("event").isin(*SETTERS), F.col("stamp"))
    sets = rows.groupBy("file_id").agg(F.max(setting).alias("set_at"), F.max_by("event", setting).alias("set_event"))
    begin = F.when(F.col("set_event") == "requeued", SETTERS["requeued"]).when(F.col("set_event") == "removed", SETTERS["removed"]).otherwise(F.col("status"))
    begun = files.select(F.col("id").alias("file_id"), "status").join(sets, "file_id", "left").select("file_id", "set_at", begin.alias("begin"))
    since = rows.join(begun.where(F.col("begin").isin("queued", "processing")), "file_id").where(F.col("set_at").isNull() | (F.col("stamp") > F.col("set_at")))
    claims = since.where("begin = 'queued' AND event = 'claimed'").groupBy("file_id").agg(F.min("stamp").alias("claim_at"))
    ends = since.where(F.col("event").isin(*OUTCOMES)).join(claims, "file_id", "left").where((F.col("begin") == "processing") | (F.col("stamp") > F.col("claim_at")))
    ends = ends.groupBy("file_id").agg(F.min_by("event", "stamp").alias("outcome"))
    running = (F.col("begin") == "processing") | F.col("claim_at").isNotNull()
    final = F.coalesce(F.col("outcome"), F.when(running, "processing").otherwise(F.col("begin")))
    return begun.join(claims, "file_id", "left").join(ends, "file_id", "left").select(F.col("file_id").alias("id"), final.alias("status"))


def changed_meanwhile(started: DataFrame, ended: DataFrame) -> DataFrame:
    """(id, new_status) of files that changed while they were indexed: queued again if edited, deleted if gone."""
    now = ended.select("rel_path", F.col("size_bytes").alias("now_size"), F.col("mtime").alias("now_mtime"), F.lit(True).alias("here"))
    differs = (F.col("size_bytes") != F.col("now_size")) | (F.col("mtime") != F.col("now_mtime"))
    status = F.when(F.col("here").isNull(), "deleted").when(differs, "queued")
    return started.join(now, "rel_path", "left").select("id", status.alias("new_status")).where("new_status IS NOT NULL")


def without_folders(gone: DataFrame, projects: DataFrame, files: DataFrame, chunks: DataFrame, jobs: DataFrame) -> dict[str, DataFrame]:
    """The tables that are left after folders (id) are deleted: their projects, files, chunks and jobs go too."""
    folder = gone.select(F.col("id").alias("folder_id"))
    lost = files.join(folder, "folder_id", "left_semi").select(F.col("id").alias("file_id"))
    return {
        "projects": projects.join(folder, "folder_id", "left_anti"),
        "files": files.join(folder, "folder_id", "left_anti"),
        "chunks": chunks.join(lost, "file_id", "left_anti"),
        "jobs": jobs.join(lost, "file_id", "left_anti"),
    }


def without_conversations(messages: DataFrame, owners: DataFrame, asked: DataFrame) -> DataFrame:
    """Messages after users (conv_id, user_id) asked to delete conversations: only their owners' wishes count."""
    return messages.join(asked.join(owners, ["conv_id", "user_id"], "left_semi"), "conv_id", "left_anti")


def section_headings(chunks: DataFrame) -> DataFrame:
    """(file_id, heading, place): the distinct headings of each file in order."""
    named = chunks.where(F.length("heading") > 0).select("file_id", "heading").distinct()
    return named.withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy("heading")))


def file_locations(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files with their folder: where each lies, and whether its folder is enabled."""
    folder = folders.select(F.col("id").alias("folder_id"), F.col("display_name").alias("folder"), "enabled")
    return files.join(folder, "folder_id").select("id", F.concat_ws("/", "folder", "rel_path").alias("path"), "enabled")


def frozen_cards(citations: DataFrame, files: DataFrame) -> DataFrame:
    """Cited cards as they are to be kept: with the name and the hash that the file has at the time of the answer."""
    now = files.select(F.col("id").alias("file_id"), "file_name", F.col("sha256").alias("file_sha256"))
    return citations.join(now, "file_id", "left").select("message_id", "marker", "file_id", "page", "file_name", "file_sha256")


def start_sessions(logins: DataFrame) -> DataFrame:
    """Logins (id, user_id, happened_at) as sessions with the time that they run out."""
    return logins.select("id", "user_id", (F.col("happened_at") + F.make_dt_interval(days=F.lit(SESSION_DAYS))).alias("expires_at"))


def last_logins(users: DataFrame, logins: DataFrame) -> DataFrame:
    """(id, last_login_at) of all users; null for those who never came."""
    last = logins.groupBy(F.col("user_id").alias("id")).agg(F.max("happened_at").alias("last_login_at"))
    return users.select("id").join(last, "id", "left")


def session_users(sessions: DataFrame, ended: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """(id, user_id, role) of sessions that were not ended, have not run out and belong to active users."""
    live = sessions.where(F.col("expires_at") > now).join(ended.select("id"), "id", "left_anti")
    return live.join(users.where("active").select(F.col("id").alias("user_id"), "role"), "user_id").select("id", "user_id", "role")


def roots_of(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root, below): the most specific root (path) that each path lies under; null if there is none.

    Every path is spread over its own ancestors, one row for each level, so that the join with roots is an equality.
    """
    parts = F.split("path", "/")
    levels = paths.select("id", "path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    keyed = levels.withColumn("root", F.array_join(F.slice(F.split("path", "/"), 1, F.col("depth")), "/"))
    best = keyed.join(roots.select(F.col("path").alias("root")).distinct(), "root", "left_semi").groupBy("id").agg(F.max_by("root", "depth").alias("root"))
    return paths.join(best, "id", "left").select("id", "root", F.expr("substring(path, length(root) + 2)").alias("below"))
