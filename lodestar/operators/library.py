"""Folders, files and conversations: diffs, listings, counts, previews and what their changes cascade to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.constants import BACKLOG_PRIORITY, FILE_STATUSES, KIND_PRIORITY, OTHER_SECONDS, PREVIEW_MAX_ENTRIES, RECENT_CONVERSATIONS, SECONDS_PER_FILE, SECONDS_PER_MB
from lodestar.functions.files import extension, ignored_name, kind_of
from lodestar.operators.work_queue import seconds


def lookup(table: dict, key: Column, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def folder_diff(found: DataFrame, known: DataFrame, busy: DataFrame, model: str, first_scan: bool, backlog: int = BACKLOG_PRIORITY, new: int = 5) -> DataFrame:
    """(rel_path, id, action, priority): what a scan does about each path. Rules are tried in this order.

    added; active (a job will read it anyway); revived or changed; outdated model; lost job; unchanged; and for known
    paths that were not found, removed (unless deleted before).
    """
    here = found.select("rel_path", F.col("size_bytes").alias("found_size"), F.col("mtime").alias("found_mtime"), "kind", F.lit(True).alias("is_found"))
    there = known.join(busy.select("id", F.lit(True).alias("is_busy")), "id", "left")
    both = here.join(there, "rel_path", "full_outer")
    differs = (F.col("size_bytes") != F.col("found_size")) | (F.col("mtime") != F.col("found_mtime"))
    action = (
        F.when(F.col("is_found").isNull(), F.when(F.col("status") == "deleted", "gone").otherwise("removed"))
        .when(F.col("id").isNull(), "added")
        .when(F.col("is_busy"), "active")
        .when(F.col("status") == "deleted", "revived")
        .when(differs, "changed")
        .when((F.col("status") == "indexed") & (F.col("model") != model), "outdated")
        .when(F.col("status").isin("queued", "processing"), "lost")
        .otherwise("unchanged")
    )
    usual = F.lit(backlog if first_scan else new) + lookup(KIND_PRIORITY, F.col("kind"), 0)
    both = both.withColumn("action", action)
    priority = F.when(F.col("action") == "outdated", backlog).when(F.col("action").isin("added", "revived", "changed", "lost"), usual)
    return both.select("rel_path", "id", "action", priority.alias("priority"))


def project_counts(projects: DataFrame, files: DataFrame) -> DataFrame:
    of = files.groupBy("project_id").agg(F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status").isin("queued", "processing")).alias("pending"))
    rows = projects.join(of, projects.id == of.project_id, "left")
    return rows.select("id", "name", F.coalesce("indexed", F.lit(0)).alias("indexed"), F.coalesce("pending", F.lit(0)).alias("pending"))


def folder_status_counts(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Files of each folder by status; folders without files have zeros."""
    of = files.groupBy("folder_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in FILE_STATUSES])
    rows = folders.join(of, folders.id == of.folder_id, "left")
    return rows.select("id", "display_name", *[F.coalesce(s, F.lit(0)).alias(s) for s in FILE_STATUSES])


def library_listing(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files with the job that matters most (a running one, then the newest), and their place in the listing's order."""
    order = Window.partitionBy("file_id").orderBy((F.col("status") == "running").desc(), F.col("id").desc())
    top = jobs.where(F.col("status").isin("queued", "running")).withColumn("nth", F.row_number().over(order)).where("nth = 1")
    top = top.select("file_id", F.col("id").alias("job_id"), F.col("status").alias("job_status"), "progress")
    rows = files.where("status <> 'deleted'").join(top, files.id == top.file_id, "left")
    group = F.when(F.col("status") == "processing", 0).when(F.col("status") == "failed", 1).when(F.col("status") == "queued", 2).otherwise(3)
    return rows.select("id", "rel_path", "status", group.alias("listing_group"), "job_id", "job_status", "progress")


def status_summary(files: DataFrame) -> DataFrame:
    return files.agg(*[F.count_if(F.col("status") == s).alias(s) for s in FILE_STATUSES])


def _priced(files: DataFrame) -> DataFrame:
    """Files with their kind (null: not supported, or to be ignored) and the estimated seconds of work on them."""
    kind = F.when(~ignored_name(F.col("file_name")), kind_of(F.col("file_name")))
    cost = lookup(SECONDS_PER_FILE, F.col("kind"), OTHER_SECONDS) + lookup(SECONDS_PER_MB, F.col("kind"), OTHER_SECONDS) * F.col("size_bytes") / 1_048_576
    return files.withColumn("kind", kind).withColumn("cost", F.round(cost, 6))


def folder_preview(files: DataFrame) -> DataFrame:
    """Supported files by extension: number, bytes and estimated seconds of work (rounded half to even)."""
    by = _priced(files).where("kind IS NOT NULL").groupBy(F.substring(extension(F.col("file_name")), 2, 20).alias("ext"))
    return by.agg(F.count("*").alias("n"), F.sum("size_bytes").alias("total_bytes"), F.bround(F.sum("cost"), 0).alias("estimated_seconds"))


def preview_summary(files: DataFrame, most: int = PREVIEW_MAX_ENTRIES) -> DataFrame:
    """The preview in one row; ``partial`` says that there are more entries than a preview is meant for. All are counted."""
    of_kind = lambda c: F.sum(F.when(F.col("kind").isNotNull(), F.col(c)))
    return _priced(files).agg(
        F.count("kind").alias("n"),
        F.coalesce(of_kind("size_bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.bround(of_kind("cost"), 0), F.lit(0.0)).alias("estimated_seconds"),
        (F.count("*") > most).alias("partial"),
    )


def due_folders(folders: DataFrame, now: Column, interval: int) -> DataFrame:
    return folders.where("enabled").where(F.col("last_scan_at").isNull() | (F.col("last_scan_at") < now - seconds(interval)))


def unchanged_files(files: DataFrame, digests: DataFrame, model: str) -> DataFrame:
    """Whether indexing a file again would change nothing: same digest, indexed, same model, and not forced.

    A boolean column ``force`` of ``digests`` says which files are to be read whatever they hold.
    """
    forced = F.coalesce(F.col("force"), F.lit(False)) if "force" in digests.columns else F.lit(False)
    both = files.join(digests.select("id", F.col("sha256").alias("now_sha"), forced.alias("forced")), "id")
    return both.select("id", (F.col("sha256").eqNullSafe(F.col("now_sha")) & (F.col("status") == "indexed") & (F.col("model") == model) & ~F.col("forced")).alias("unchanged"))


def conversation_view(citations: DataFrame, files: DataFrame) -> DataFrame:
    """Citations with whether their source has changed (or is gone) since, and where it opens."""
    now = files.select(F.col("id").alias("now_id"), F.col("sha256").alias("now_sha"))
    rows = citations.join(now, F.col("file_id") == F.col("now_id"), "left")
    changed = F.col("now_id").isNull() | ~F.col("sha256").eqNullSafe(F.col("now_sha"))
    url = F.concat(F.lit("/api/files/"), F.col("file_id").cast("string"), F.when(F.col("page") > 0, F.concat(F.lit("/pdf#page="), F.col("page").cast("string"))).otherwise(F.lit("/content")))
    return rows.select("message_id", "marker", "file_id", changed.alias("source_changed"), url.alias("open_url"))


def recent_conversations(messages: DataFrame, most: int = RECENT_CONVERSATIONS) -> DataFrame:
    """The conversations with the latest turns; a top-k report."""
    return messages.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("n_messages")).orderBy(F.col("last_turn").desc(), F.col("conv_id").desc()).limit(most)


def conversation_turns(messages: DataFrame) -> DataFrame:
    """User messages with the assistant's answer that follows at once, if one does."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.withColumn("next_role", F.lead("role").over(order)).withColumn("next_content", F.lead("content").over(order))
    answer = F.when(F.col("next_role") == "assistant", F.col("next_content"))
    return rows.where("role = 'user'").select("conv_id", "turn", F.col("content").alias("question"), answer.alias("answer"))


def default_model(models: DataFrame, requested: int | None) -> DataFrame:
    """The model that answers: the requested one if enabled, else the default, else the lowest id."""
    wanted = F.lit(False) if requested is None else (F.col("id") == requested)
    return models.where("enabled").orderBy(wanted.desc(), F.col("is_default").desc(), "id").limit(1).select("id", "name")


def latest_settings(changes: DataFrame, defaults: DataFrame) -> DataFrame:
    """(key, value): the last written value of each setting, or its default."""
    last = changes.groupBy("key").agg(F.max_by("value", F.struct("updated_at", "id")).alias("set_value"))
    return defaults.join(last, "key", "full_outer").select("key", F.coalesce("set_value", "value").alias("value"))


def folder_cascade(folder_ids: DataFrame, projects: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """What deleting folders takes along: number of projects, files and chunks of each."""
    gone = folder_ids.select(F.col("id").alias("folder_id"))
    p = projects.join(gone, "folder_id", "left_semi").groupBy("folder_id").agg(F.count("*").alias("n_projects"))
    lost = files.join(gone, "folder_id", "left_semi").select(F.col("id").alias("file_id"), "folder_id")
    f = lost.groupBy("folder_id").agg(F.count("*").alias("n_files"))
    c = chunks.join(lost, "file_id").groupBy("folder_id").agg(F.count("*").alias("n_chunks"))
    rows = gone.join(p, "folder_id", "left").join(f, "folder_id", "left").join(c, "folder_id", "left")
    return rows.select("folder_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_projects", "n_files", "n_chunks")])


def mark_deleted(files: DataFrame, removed: DataFrame) -> DataFrame:
    """Files after removal: removed ones stay as tombstones without a digest and, if there is such a column, an error."""
    rows = files.join(removed.select("id", F.lit(True).alias("is_removed")), "id", "left")
    hit = F.coalesce("is_removed", F.lit(False))
    emptied = [F.when(~hit, F.col(c)).alias(c) for c in ("sha256", "error") if c in files.columns]
    return rows.select("id", F.when(hit, "deleted").otherwise(F.col("status")).alias("status"), *emptied)


def chunks_left(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    """Chunks after their files' removal."""
    return chunks.join(removed.select(F.col("id").alias("file_id")), "file_id", "left_anti")


def extraction_failed(files: DataFrame, failed: DataFrame) -> DataFrame:
    """Files after a failed extraction: failed, with the new digest recorded."""
    rows = files.join(failed.select("id", F.col("sha256").alias("new_sha")), "id")
    return rows.select("id", F.lit("failed").alias("status"), F.col("new_sha").alias("sha256"))


def force_reindex(jobs: DataFrame) -> DataFrame:
    """Payloads (JSON objects, null is an empty one) of queued jobs with the force flag merged in: other keys stay as they are."""
    others = F.map_filter(F.from_json(F.coalesce("payload", F.lit("{}")), "map<string,variant>"), lambda k, _: k != "force")
    payload = F.to_json(F.map_concat(others, F.create_map(F.lit("force"), F.parse_json(F.lit("true")))))
    return jobs.where("status = 'queued'").select("id", payload.alias("payload"))


def model_switch(files: DataFrame, model: str) -> DataFrame:
    """Files to index again after the embedding model changed: none the second time."""
    return files.where(F.col("status").isin("indexed", "failed") & (F.col("model") != model)).select("id", F.lit("queued").alias("new_status"), F.lit(model).alias("model"))


def folder_name(display_name: Column, path: Column) -> Column:
    """A folder's name, or the last part of its path if it has none."""
    name = F.btrim(display_name)
    return F.coalesce(F.when(F.length(name) > 0, name), F.element_at(F.filter(F.split(path, "/"), lambda p: p != ""), -1), path)


def create_folders(folders: DataFrame, new: DataFrame) -> DataFrame:
    """Folders that may be added: paths not in use; of equal paths the one with the least name, which is made by ``folder_name``."""
    rows = new.join(folders.select("path").distinct(), "path", "left_anti").select("path", folder_name(F.col("display_name"), F.col("path")).alias("display_name"))
    return rows.groupBy("path").agg(F.min("display_name").alias("display_name"))


def update_folders(folders: DataFrame, projects: DataFrame, changes: DataFrame) -> DataFrame:
    """(folder_id, project_id, name, purge): renames reach the folder's projects, a changed path purges its files."""
    both = folders.join(changes.select(F.col("id").alias("change_id"), F.col("display_name").alias("new_name"), F.col("path").alias("new_path")), F.col("id") == F.col("change_id"))
    purge = F.col("new_path").isNotNull() & (F.col("new_path") != F.col("path"))
    rows = both.select(F.col("id").alias("folder_id"), F.coalesce("new_name", "display_name").alias("name"), purge.alias("purge"))
    return rows.join(projects.select(F.col("id").alias("project_id"), "folder_id"), "folder_id", "left")


def audit_rows(changed: DataFrame, action: str, entity: str) -> DataFrame:
    """One log row per change (id, before, after: structs), as JSON."""
    return changed.select(F.lit(action).alias("action"), F.lit(entity).alias("entity"), F.col("id").alias("entity_id"), F.to_json("before").alias("before"), F.to_json("after").alias("after"))


def answer_rows(answers: DataFrame, conversations: DataFrame) -> DataFrame:
    """Answers to append: those whose conversation still exists, with their cited cards frozen beside them."""
    return answers.join(conversations.select("conv_id").distinct(), "conv_id", "left_semi")


def bootstrap(users: DataFrame, first: DataFrame) -> DataFrame:
    """The first rows of a table, if it is empty."""
    return first.join(users.limit(1).select(F.lit(True).alias("taken")), F.lit(True), "left").where("taken IS NULL").drop("taken")


def outdated_index(files: DataFrame, version: int, model: str) -> DataFrame:
    """Files to index again: another version keeps their chunks searchable meanwhile, another model drops them."""
    old = (F.col("index_version") != version) | (F.col("model") != model)
    return files.where(old & (F.col("status") == "indexed")).select("id", F.lit("queued").alias("new_status"), (F.col("model") != model).alias("drop_chunks"))


def browse(listing: DataFrame) -> DataFrame:
    """Visible folders of a listing (name, is_dir) with what a browser orders them by: the name without case, then the name."""
    visible = listing.where(F.col("is_dir") & ~F.substring("name", 1, 1).isin(".", "$", "~"))
    return visible.select("name", F.lower("name").alias("sort_key"))


def model_list(models: DataFrame) -> DataFrame:
    """Enabled models with what they are listed by: the default ones first, then the name."""
    return models.where("enabled").select("id", "name", F.concat(F.when(F.col("is_default"), "0 ").otherwise("1 "), "name").alias("sort_key"))


def valid_interval(seconds: Column) -> Column:
    """Rescan intervals that settings accept."""
    return seconds.between(30, 86_400)
