"""Queries over access, the work queue, folders, files and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.constants import ALIVE_SECONDS, LOST_WORKER, RESCAN_SECONDS
from lodestar.functions.files import allowed_extensions, extension, ignored_name, kind_of
from lodestar.operators import access, library
from lodestar.operators import work_queue as queue
from lodestar.plans.base import Query
from lodestar.plans.views import NOW

now = lambda: F.expr(NOW)

VISIBLE = """
open_projects AS (SELECT p.id AS project_id FROM projects p JOIN folders f ON f.id = p.folder_id WHERE f.enabled),
visible AS (
  SELECT DISTINCT g.user_id, g.project_id FROM grants g JOIN users u ON u.id = g.user_id JOIN open_projects o ON o.project_id = g.project_id WHERE u.role <> 'admin'
  UNION ALL SELECT u.id, o.project_id FROM users u, open_projects o WHERE u.role = 'admin')
"""
ACCESS = ("users", "folders", "projects", "grants")
EXT = r"lower(regexp_extract(regexp_extract(file_name, '[^/]*$'), '^\.*[^.].*(\.[^.]*)$', 1))"
KIND = f"CASE WHEN {EXT} = '.pdf' THEN 'pdf' WHEN {EXT} IN ('.docx', '.doc', '.odt', '.rtf', '.pptx', '.ppt', '.odp') THEN 'office' WHEN {EXT} IN ('.txt', '.md', '.markdown') THEN 'text' END"
IGNORED = "(starts_with(file_name, '~$') OR starts_with(file_name, '.~lock') OR starts_with(file_name, '.') OR ends_with(file_name, '.tmp') OR ends_with(file_name, '.crdownload') OR ends_with(file_name, '.part'))"
TWIN = "twins AS (SELECT DISTINCT dedupe_key AS k FROM jobs WHERE status = 'queued' AND dedupe_key IS NOT NULL)"


def new_jobs(jobs):
    return jobs.where("id % 2 = 0").select("id", "dedupe_key")


def preset(changes):
    return changes.sparkSession.createDataFrame([("scan_interval", "300"), ("theme", "light"), ("purchase", "none")], "key string, value string")


QUERIES: dict[str, Query] = {
    "project_access": Query(ACCESS, access.visible_projects, f"WITH {VISIBLE} SELECT user_id, project_id FROM visible"),
    "requested_projects": Query(
        (*ACCESS, "requests"),
        lambda u, f, p, g, r: access.allowed_projects(access.visible_projects(u, f, p, g), r),
        f"WITH {VISIBLE} SELECT v.user_id, v.project_id FROM visible v JOIN requests r ON r.user_id = v.user_id WHERE r.requested IS NULL OR r.requested = v.project_id",
    ),
    "file_access": Query(
        (*ACCESS, "files"),
        lambda u, f, p, g, files: access.openable_counts(access.visible_projects(u, f, p, g), files),
        f"WITH {VISIBLE} SELECT v.user_id, count(*) AS n_files FROM visible v JOIN files f ON f.project_id = v.project_id GROUP BY v.user_id",
    ),
    "valid_sessions": Query(("users",), lambda u: access.valid_sessions(u, now()).select("id", "role"), f"SELECT id, role FROM users WHERE active AND expires_at > {NOW}"),
    "file_kinds": Query(
        ("files",),
        lambda f: f.select("id", extension(F.col("file_name")).alias("ext"), kind_of(F.col("file_name")).alias("kind"), ignored_name(F.col("file_name")).alias("ignored")),
        f"SELECT id, {EXT} AS ext, {KIND} AS kind, {IGNORED} AS ignored FROM files",
    ),
    "allowed_files": Query(
        ("files",),
        lambda f: f.where(extension(F.col("file_name")).isin(*allowed_extensions(["word", "md", "exe"]))).select("id"),
        f"SELECT id FROM files WHERE {EXT} IN ('.docx', '.doc', '.odt', '.rtf', '.md')",
    ),
    "project_counts": Query(
        ("projects", "files"),
        library.project_counts,
        "SELECT p.id, p.name, count(f.id) FILTER (f.status = 'indexed') AS indexed, count(f.id) FILTER (f.status IN ('queued', 'processing')) AS pending FROM projects p LEFT JOIN files f ON f.project_id = p.id GROUP BY p.id, p.name",
    ),
    "folder_status_counts": Query(
        ("folders", "files"),
        library.folder_status_counts,
        "SELECT d.id, d.display_name, " + ", ".join(f"count(f.id) FILTER (f.status = '{s}') AS {s}" for s in ("indexed", "queued", "processing", "failed")) + " FROM folders d LEFT JOIN files f ON f.folder_id = d.id GROUP BY d.id, d.display_name",
    ),
    "status_summary": Query(("files",), library.status_summary, "SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("indexed", "queued", "processing", "failed")) + " FROM files"),
    "first_run": Query(("folders",), lambda f: f.agg((F.count("*") == 0).alias("first_run")), "SELECT count(*) = 0 AS first_run FROM folders"),
    "library_listing": Query(
        ("files", "jobs"),
        library.library_listing,
        """SELECT f.id, f.rel_path, f.status, CASE f.status WHEN 'processing' THEN 0 WHEN 'failed' THEN 1 WHEN 'queued' THEN 2 ELSE 3 END AS listing_group,
        j.id AS job_id, j.status AS job_status, j.progress FROM files f
        LEFT JOIN (SELECT * FROM jobs WHERE status IN ('queued', 'running') QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY (status = 'running') DESC, id DESC) = 1) j ON j.file_id = f.id
        WHERE f.status <> 'deleted'""",
    ),
    "folder_preview": Query(
        ("files",),
        library.folder_preview,
        f"""WITH k AS (SELECT *, {EXT} AS e, {KIND} AS kind FROM files WHERE NOT {IGNORED})
        SELECT substring(e, 2) AS ext, count(*) AS n, sum(size_bytes)::BIGINT AS total_bytes,
        round_even(sum(round(CASE kind WHEN 'pdf' THEN 3.0 WHEN 'office' THEN 8.0 ELSE 0.5 END::DOUBLE + CASE kind WHEN 'pdf' THEN 2.5 WHEN 'office' THEN 4.0 ELSE 1.0 END::DOUBLE * size_bytes / 1048576, 6)), 0) AS estimated_seconds
        FROM k WHERE kind IS NOT NULL GROUP BY e""",
    ),
    "folder_diff": Query(
        ("found", "known", "jobs", "files"),
        lambda found, known, jobs, files: library.folder_diff(found, known, queue.active_files(jobs, files), "multilingual-e5-small", False),
        """WITH busy AS (SELECT DISTINCT f.id FROM files f JOIN jobs j ON j.file_id = f.id WHERE j.status IN ('queued', 'running')),
        b AS (SELECT coalesce(n.rel_path, k.rel_path) AS rel_path, k.id, n.kind, n.rel_path IS NOT NULL AS here, b.id IS NOT NULL AS busy, k.status, k.model,
          k.size_bytes <> n.size_bytes OR k.mtime <> n.mtime AS differs FROM found n FULL JOIN (known k LEFT JOIN busy b ON b.id = k.id) ON k.rel_path = n.rel_path),
        a AS (SELECT *, CASE WHEN NOT here THEN CASE WHEN status = 'deleted' THEN 'gone' ELSE 'removed' END WHEN id IS NULL THEN 'added' WHEN busy THEN 'active' WHEN status = 'deleted' THEN 'revived'
          WHEN differs THEN 'changed' WHEN status = 'indexed' AND model <> 'multilingual-e5-small' THEN 'outdated' WHEN status IN ('queued', 'processing') THEN 'lost' ELSE 'unchanged' END AS action FROM b)
        SELECT rel_path, id, action, CASE WHEN action = 'outdated' THEN 0 WHEN action IN ('added', 'revived', 'changed', 'lost') THEN 5 + CASE kind WHEN 'text' THEN 2 WHEN 'pdf' THEN 1 ELSE 0 END END AS priority FROM a""",
    ),
    "unchanged_files": Query(
        ("files", "known"),
        lambda f, k: library.unchanged_files(f, k.select("id", F.concat(F.lit("h"), (F.col("size_bytes") / 100000).cast("int").cast("string")).alias("sha256")), "bge-m3"),
        "SELECT f.id, f.sha256 = concat('h', k.size_bytes // 100000) AND f.status = 'indexed' AND f.model = 'bge-m3' AS unchanged FROM files f JOIN known k ON k.id = f.id",
    ),
    "due_folders": Query(("folders",), lambda f: library.due_folders(f, now(), RESCAN_SECONDS).select("id"), f"SELECT id FROM folders WHERE enabled AND (last_scan_at IS NULL OR last_scan_at < {NOW} - INTERVAL 300 SECONDS)"),
    "queue_depth": Query(("jobs",), queue.depth, "SELECT lane, count(*) AS n FROM jobs WHERE status IN ('queued', 'running') GROUP BY lane"),
    "queue_claim": Query(
        ("jobs",),
        lambda j: queue.claim(j, now()).select("lane", "id", "status", "attempts"),
        f"SELECT lane, id, 'running' AS status, attempts + 1 AS attempts FROM jobs WHERE status = 'queued' AND run_after <= {NOW} QUALIFY row_number() OVER (PARTITION BY lane ORDER BY priority DESC, id) = 1",
    ),
    "queue_dedupe": Query(
        ("jobs",),
        lambda j: queue.enqueue(j.where("id % 2 = 1"), new_jobs(j)).select("id", "dedupe_key"),
        """SELECT id, dedupe_key FROM jobs n WHERE id % 2 = 0 AND (dedupe_key IS NULL OR NOT EXISTS (SELECT 1 FROM jobs q WHERE q.id % 2 = 1 AND q.status = 'queued' AND q.dedupe_key = n.dedupe_key))
        QUALIFY dedupe_key IS NULL OR row_number() OVER (PARTITION BY dedupe_key ORDER BY id) = 1""",
    ),
    "queue_retry": Query(
        ("jobs",),
        lambda j: queue.fail(j, now()),
        f"SELECT id, CASE WHEN attempts < max_attempts THEN 'queued' ELSE 'failed' END AS new_status, CASE WHEN attempts < max_attempts THEN {NOW} + to_seconds(30 * attempts) ELSE run_after END AS new_run_after FROM jobs WHERE status = 'running'",
    ),
    "queue_reap": Query(
        ("jobs",),
        lambda j: queue.reap(j, now()),
        f"""WITH {TWIN} SELECT j.id, CASE WHEN t.k IS NOT NULL THEN 'cancelled' WHEN attempts < max_attempts THEN 'queued' ELSE 'failed' END AS new_status,
        CASE WHEN t.k IS NULL THEN '{LOST_WORKER}' END AS error FROM jobs j LEFT JOIN twins t ON t.k = j.dedupe_key WHERE j.status = 'running' AND heartbeat_at < {NOW} - INTERVAL 120 SECONDS""",
    ),
    "queue_requeue": Query(
        ("jobs",),
        lambda j: queue.requeue(j, now(), 10),
        f"""WITH {TWIN} SELECT j.id, CASE WHEN t.k IS NOT NULL THEN 'cancelled' ELSE 'queued' END AS new_status, CASE WHEN t.k IS NOT NULL THEN attempts ELSE attempts - 1 END AS new_attempts,
        CASE WHEN t.k IS NOT NULL THEN run_after ELSE {NOW} + INTERVAL 10 SECONDS END AS new_run_after FROM jobs j LEFT JOIN twins t ON t.k = j.dedupe_key WHERE j.status = 'running'""",
    ),
    "queue_release": Query(
        ("jobs",),
        queue.release,
        f"WITH {TWIN} SELECT j.id, 'queued' AS new_status, greatest(attempts - 1, 0) AS new_attempts FROM jobs j WHERE j.status = 'running' AND NOT EXISTS (SELECT 1 FROM twins t WHERE t.k = j.dedupe_key)",
    ),
    "active_files": Query(("jobs", "files"), queue.active_files, "SELECT id FROM files f WHERE EXISTS (SELECT 1 FROM jobs j WHERE j.file_id = f.id AND j.status IN ('queued', 'running'))"),
    "orphan_reset": Query(("files", "jobs"), queue.orphaned, "SELECT id, 'queued' AS new_status FROM files f WHERE status = 'processing' AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.file_id = f.id AND j.status = 'running')"),
    "job_progress": Query(
        ("heartbeats",),
        queue.progress,
        "SELECT service, max(seen_at) AS last_seen, (SELECT value FROM heartbeats x WHERE x.service = h.service AND x.value IS NOT NULL ORDER BY seen_at DESC, id DESC LIMIT 1) AS progress FROM heartbeats h GROUP BY service",
    ),
    "worker_health": Query(
        ("heartbeats",),
        lambda h: queue.alive(h, F.expr("TIMESTAMP '2024-01-30 00:00:00'"), ALIVE_SECONDS),
        "SELECT service, max(seen_at) AS last_seen, TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 45 SECONDS < max(seen_at) AS alive FROM heartbeats GROUP BY service",
    ),
    "conversation_view": Query(
        ("citations", "files"),
        lambda c, f: library.conversation_view(c, f.where("id % 10 <> 3")),
        "SELECT c.message_id, c.marker, c.file_id, f.id IS NULL OR c.sha256 <> f.sha256 AS source_changed, concat('/api/files/', c.file_id, CASE WHEN c.page > 0 THEN concat('/pdf#page=', c.page) ELSE '/content' END) AS open_url FROM citations c LEFT JOIN files f ON f.id = c.file_id AND f.id % 10 <> 3",
    ),
    "recent_conversations": Query(("messages",), library.recent_conversations, "SELECT conv_id, max(turn) AS last_turn, count(*) AS n_messages FROM messages GROUP BY conv_id ORDER BY last_turn DESC, conv_id DESC LIMIT 30"),
    "conversation_turns": Query(
        ("messages",),
        library.conversation_turns,
        """SELECT conv_id, turn, content AS question, CASE WHEN nr = 'assistant' THEN nc END AS answer FROM
        (SELECT *, lead(role) OVER w AS nr, lead(content) OVER w AS nc FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""",
    ),
    "default_model": Query(("models",), lambda m: library.default_model(m, None), "SELECT id, name FROM models WHERE enabled ORDER BY is_default DESC, id LIMIT 1"),
    "model_list": Query(("models",), library.model_list, "SELECT id, name, concat(CASE WHEN is_default THEN '0 ' ELSE '1 ' END, name) AS sort_key FROM models WHERE enabled"),
    "settings_latest": Query(
        ("heartbeats",),
        lambda h: library.latest_settings(h.select("id", F.col("service").alias("key"), F.col("user_id").cast("string").alias("value"), F.col("seen_at").alias("updated_at")), preset(h)),
        """WITH d AS (SELECT * FROM (VALUES ('scan_interval', '300'), ('theme', 'light'), ('purchase', 'none')) AS t(key, value)),
        l AS (SELECT service AS key, arg_max(user_id, (seen_at, id))::VARCHAR AS value FROM heartbeats GROUP BY service)
        SELECT coalesce(d.key, l.key) AS key, coalesce(l.value, d.value) AS value FROM d FULL JOIN l ON l.key = d.key""",
    ),
    "folder_cascade": Query(
        ("folders", "projects", "files", "chunk_files"),
        library.folder_cascade,
        """SELECT d.id AS folder_id, (SELECT count(*) FROM projects p WHERE p.folder_id = d.id) AS n_projects, (SELECT count(*) FROM files f WHERE f.folder_id = d.id) AS n_files,
        (SELECT count(*) FROM files f JOIN chunk_files c ON c.file_id = f.id WHERE f.folder_id = d.id) AS n_chunks FROM folders d""",
    ),
    "mark_deleted": Query(
        ("files", "found"),
        lambda f, n: library.mark_deleted(f, f.join(n.select("rel_path"), "rel_path", "left_anti")),
        "SELECT f.id, CASE WHEN n.rel_path IS NULL THEN 'deleted' ELSE f.status END AS status, CASE WHEN n.rel_path IS NOT NULL THEN f.sha256 END AS sha256 FROM files f LEFT JOIN found n ON n.rel_path = f.rel_path",
    ),
    "chunks_left": Query(
        ("chunk_files", "files"),
        lambda c, f: library.chunks_left(c, f.where("status = 'deleted'")).groupBy("file_id").agg(F.count("*").alias("n")),
        "SELECT file_id, count(*) AS n FROM chunk_files c WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.id = c.file_id AND f.status = 'deleted') GROUP BY file_id",
    ),
    "extraction_failed": Query(("files", "known"), lambda f, k: library.extraction_failed(f, k.where("status = 'processing'").select("id", F.sha2("rel_path", 256).alias("sha256"))), "SELECT f.id, 'failed' AS status, sha256(k.rel_path) AS sha256 FROM files f JOIN known k ON k.id = f.id WHERE k.status = 'processing'"),
    "force_reindex": Query(("jobs",), library.force_reindex, "SELECT id, CASE WHEN id % 4 = 3 THEN '{\"force\":true}' ELSE concat('{\"file_id\":', file_id, ',\"pages\":[1,', id, '],\"force\":true}') END AS payload FROM jobs WHERE status = 'queued'"),
    "model_switch": Query(("files",), lambda f: library.model_switch(f, "bge-m3"), "SELECT id, 'queued' AS new_status, 'bge-m3' AS model FROM files WHERE status IN ('indexed', 'failed') AND model <> 'bge-m3'"),
    "folder_create": Query(
        ("files",),
        lambda f: library.create_folders(f.where("id % 2 = 0").select(F.col("rel_path").alias("path")), f.select(F.col("rel_path").alias("path"), F.when(F.col("id") % 3 == 0, F.col("file_name")).otherwise("").alias("display_name")).unionByName(f.where("id % 5 = 0").select(F.col("rel_path").alias("path"), F.lit(" ~ ").alias("display_name")))),
        """WITH n AS (SELECT id, rel_path AS path, CASE WHEN id % 3 = 0 THEN file_name ELSE regexp_extract(rel_path, '([^/]+)/*$', 1) END AS name FROM files UNION ALL SELECT id, rel_path, '~' FROM files WHERE id % 5 = 0)
        SELECT path, min(name) AS display_name FROM n WHERE NOT EXISTS (SELECT 1 FROM files o WHERE o.id % 2 = 0 AND o.rel_path = n.path) GROUP BY path""",
    ),
    "folder_update": Query(
        ("folders", "projects"),
        lambda f, p: library.update_folders(f.withColumn("path", F.concat(F.lit("/srv/"), "display_name")), p, f.where("id <> 1").select("id", F.when(F.col("id") == 2, "Renamed").alias("display_name"), F.when(F.col("id") == 3, "/srv/new").otherwise(F.concat(F.lit("/srv/"), "display_name")).alias("path"))),
        "SELECT f.id AS folder_id, CASE WHEN f.id = 2 THEN 'Renamed' ELSE f.display_name END AS name, f.id = 3 AS purge, p.id AS project_id FROM folders f LEFT JOIN projects p ON p.folder_id = f.id WHERE f.id <> 1",
    ),
    "audit_log": Query(
        ("jobs",),
        lambda j: library.audit_rows(j.where("status = 'running'").select("id", F.struct("status", "attempts").alias("before"), F.struct(F.lit("queued").alias("status"), (F.col("attempts") + 1).alias("attempts")).alias("after")), "requeue", "job"),
        """SELECT 'requeue' AS action, 'job' AS entity, id AS entity_id, concat('{"status":"', status, '","attempts":', attempts, '}') AS before, concat('{"status":"queued","attempts":', attempts + 1, '}') AS after FROM jobs WHERE status = 'running'""",
    ),
    "answer_sink": Query(
        ("messages",),
        lambda m: library.answer_rows(m.where("role = 'assistant'").select("conv_id", "turn"), m.where("role = 'system'")),
        "SELECT conv_id, turn FROM messages a WHERE role = 'assistant' AND EXISTS (SELECT 1 FROM messages s WHERE s.role = 'system' AND s.conv_id = a.conv_id)",
    ),
    "bootstrap_rows": Query(
        ("users", "models"),
        lambda u, m: library.bootstrap(u.where("id < 0"), m.where("is_default").select("id", "name")).unionByName(library.bootstrap(u, m.select("id", "name"))),
        "SELECT id, name FROM models WHERE is_default",
    ),
    "index_outdated": Query(
        ("files",),
        lambda f: library.outdated_index(f.withColumn("index_version", F.when(F.col("id") % 4 == 0, 4).otherwise(5)), 5, "bge-m3"),
        "SELECT id, 'queued' AS new_status, model <> 'bge-m3' AS drop_chunks FROM files WHERE status = 'indexed' AND (id % 4 = 0 OR model <> 'bge-m3')",
    ),
    "folder_browser": Query(
        ("files",),
        lambda f: library.browse(f.select(F.concat("file_name", "id").alias("name"), (F.col("project_id") == 7).alias("is_dir"))),
        "SELECT name, lower(name) AS sort_key FROM (SELECT concat(file_name, id) AS name FROM files WHERE project_id = 7) WHERE substring(name, 1, 1) NOT IN ('.', '$', '~')",
    ),
    "setting_bounds": Query(("files",), lambda f: f.select("id", library.valid_interval(F.col("size_bytes") / 50000).alias("valid")), "SELECT id, size_bytes / 50000 BETWEEN 30 AND 86400 AS valid FROM files"),
    "path_filter": Query(("files",), lambda f: f.where(F.lower("rel_path").contains("brand#1")).select("id"), "SELECT id FROM files WHERE contains(lower(rel_path), 'brand#1')"),
}
