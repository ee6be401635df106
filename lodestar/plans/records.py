"""Queries over the lives of files, jobs, sessions and conversations, and over labels for people."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lodestar.constants import LANE_WIDTHS
from lodestar.functions import display, text
from lodestar.operators import library, records
from lodestar.operators import work_queue as queue
from lodestar.plans.base import Query
from lodestar.plans.state import IGNORED, KIND, now
from lodestar.plans.views import NOW

SIZE = "size_bytes * id * id"


def left_rows(gone, projects, files, chunks, jobs):
    left = records.without_folders(gone.where("id IN (1, 3)").select("id"), projects, files, chunks, jobs)
    return reduce(lambda a, b: a.unionByName(b), [t.agg(F.lit(name).alias("of"), F.count("*").alias("n")) for name, t in left.items()])


def turns_left(messages):
    owners = messages.select("conv_id", (F.col("conv_id") % 5).alias("user_id")).distinct()
    asked = messages.where("conv_id % 3 = 0").select("conv_id", (F.col("conv_id") % 2).alias("user_id")).distinct()
    return records.without_conversations(messages, owners, asked).groupBy("conv_id").agg(F.count("*").alias("n"))


QUERIES: dict[str, Query] = {
    "file_states": Query(
        ("files", "file_events"),
        records.after_events,
        """WITH h AS (SELECT file_id, list(event ORDER BY happened_at, id) AS events FROM file_events GROUP BY file_id)
        SELECT f.id, list_reduce(list_concat([f.status], coalesce(h.events, [])), lambda s, e: CASE WHEN e = 'removed' THEN 'deleted' WHEN e = 'requeued' THEN 'queued'
          WHEN e = 'claimed' AND s = 'queued' THEN 'processing' WHEN e IN ('indexed', 'failed') AND s = 'processing' THEN e ELSE s END) AS status
        FROM files f LEFT JOIN h ON h.file_id = f.id""",
    ),
    "changed_meanwhile": Query(
        ("known", "found"),
        records.changed_meanwhile,
        """SELECT k.id, CASE WHEN n.rel_path IS NULL THEN 'deleted' ELSE 'queued' END AS new_status FROM known k LEFT JOIN found n ON n.rel_path = k.rel_path
        WHERE n.rel_path IS NULL OR n.size_bytes <> k.size_bytes OR n.mtime <> k.mtime""",
    ),
    "folder_delete": Query(
        ("folders", "projects", "files", "chunk_files", "jobs"),
        left_rows,
        """WITH lost AS (SELECT id FROM files WHERE folder_id IN (1, 3))
        SELECT 'projects' AS of, count(*) AS n FROM projects WHERE folder_id NOT IN (1, 3) UNION ALL SELECT 'files', count(*) FROM files WHERE folder_id NOT IN (1, 3)
        UNION ALL SELECT 'chunks', count(*) FROM chunk_files WHERE file_id NOT IN (FROM lost) UNION ALL SELECT 'jobs', count(*) FROM jobs WHERE file_id NOT IN (FROM lost)""",
    ),
    "conversation_delete": Query(("messages",), turns_left, "SELECT conv_id, count(*) AS n FROM messages WHERE NOT (conv_id % 3 = 0 AND conv_id % 5 = conv_id % 2) GROUP BY conv_id"),
    "section_headings": Query(
        ("headed",),
        records.section_headings,
        "SELECT file_id, heading, row_number() OVER (PARTITION BY file_id ORDER BY heading) AS place FROM (SELECT DISTINCT file_id, heading FROM headed WHERE heading <> '')",
    ),
    "file_locations": Query(("files", "folders"), records.file_locations, "SELECT f.id, concat(d.display_name, '/', f.rel_path) AS path, d.enabled FROM files f JOIN folders d ON d.id = f.folder_id"),
    "frozen_cards": Query(
        ("citations", "files"),
        lambda c, f: records.frozen_cards(c, f.where("id % 10 <> 3")),
        "SELECT c.message_id, c.marker, c.file_id, c.page, f.file_name, f.sha256 AS file_sha256 FROM citations c LEFT JOIN (FROM files WHERE id % 10 <> 3) f ON f.id = c.file_id",
    ),
    "session_start": Query(("logins",), records.start_sessions, "SELECT id, user_id, happened_at + INTERVAL 14 DAYS AS expires_at FROM logins"),
    "last_logins": Query(("users", "logins"), records.last_logins, "SELECT u.id, max(l.happened_at) AS last_login_at FROM users u LEFT JOIN logins l ON l.user_id = u.id GROUP BY u.id"),
    "session_users": Query(
        ("logins", "users"),
        lambda s, u: records.session_users(records.start_sessions(s), s.where("id % 4 = 0"), u, now()),
        f"SELECT s.id, s.user_id, u.role FROM logins s JOIN users u ON u.id = s.user_id WHERE u.active AND s.happened_at + INTERVAL 14 DAYS > {NOW} AND s.id % 4 <> 0",
    ),
    "path_roots": Query(
        ("files",),
        lambda f: records.roots_of(f.select("id", F.col("rel_path").alias("path")), f.where("id % 7 = 0").select(F.element_at(F.split("rel_path", "/"), 1).alias("path")).unionByName(f.where("id % 3 = 0").select(F.col("rel_path").alias("path")))),
        """WITH r AS (SELECT split_part(rel_path, '/', 1) AS path FROM files WHERE id % 7 = 0 UNION SELECT rel_path FROM files WHERE id % 3 = 0),
        b AS (SELECT f.id, arg_max(r.path, length(r.path)) AS root FROM files f JOIN r ON f.rel_path = r.path OR starts_with(f.rel_path, r.path || '/') GROUP BY f.id)
        SELECT f.id, b.root, substring(f.rel_path, length(b.root) + 2) AS below FROM files f LEFT JOIN b ON b.id = f.id""",
    ),
    "preview_summary": Query(
        ("files",),
        lambda f: library.preview_summary(f, 150),
        f"""WITH k AS (SELECT *, CASE WHEN NOT {IGNORED} THEN {KIND} END AS kind FROM files)
        SELECT count(kind) AS n, coalesce(sum(size_bytes) FILTER (kind IS NOT NULL), 0)::BIGINT AS total_bytes,
        coalesce(round_even(sum(round(CASE kind WHEN 'pdf' THEN 3.0 WHEN 'office' THEN 8.0 ELSE 0.5 END::DOUBLE + CASE kind WHEN 'pdf' THEN 2.5 WHEN 'office' THEN 4.0 ELSE 1.0 END::DOUBLE * size_bytes / 1048576, 6))
          FILTER (kind IS NOT NULL), 0), 0.0::DOUBLE) AS estimated_seconds, count(*) > 150 AS partial FROM k""",
    ),
    "queue_lanes": Query(
        ("jobs",),
        lambda j: queue.claim(j.where("id % 50 = 0 OR status <> 'running'"), now(), LANE_WIDTHS | {"doc": 2_000}).select("lane", "id", "attempts"),
        f"""WITH j AS (SELECT * FROM jobs WHERE id % 50 = 0 OR status <> 'running')
        SELECT lane, id, attempts + 1 AS attempts FROM j q WHERE status = 'queued' AND run_after <= {NOW}
        QUALIFY row_number() OVER (PARTITION BY lane ORDER BY priority DESC, id) <= CASE lane WHEN 'doc' THEN 2000 ELSE 1 END - (SELECT count(*) FROM j r WHERE r.status = 'running' AND r.lane = q.lane)""",
    ),
    "queue_complete": Query(
        ("jobs",),
        lambda j: queue.complete(j, j.where("id % 2 = 0"), now()),
        f"SELECT id, 'done' AS new_status, 1.0::DOUBLE AS progress, {NOW} AS finished_at FROM jobs WHERE status = 'running' AND id % 2 = 0",
    ),
    "progress_throttled": Query(
        ("heartbeats",),
        lambda h: queue.throttled(h, 3_600),
        "SELECT service, seen_at, id, value FROM heartbeats QUALIFY row_number() OVER (PARTITION BY service, floor(epoch(seen_at) / 3600) ORDER BY seen_at DESC, id DESC) = 1",
    ),
    "unchanged_unless_forced": Query(
        ("files",),
        lambda f: library.unchanged_files(f, f.select("id", "sha256", (F.col("id") % 4 == 0).alias("force")), "bge-m3"),
        "SELECT id, sha256 IS NOT NULL AND status = 'indexed' AND model = 'bge-m3' AND id % 4 <> 0 AS unchanged FROM files",
    ),
    "tombstones": Query(
        ("files",),
        lambda f: library.mark_deleted(f.withColumn("error", F.concat(F.lit("e"), F.col("id"))), f.where("id % 3 = 0")),
        "SELECT id, CASE WHEN id % 3 = 0 THEN 'deleted' ELSE status END AS status, CASE WHEN id % 3 <> 0 THEN sha256 END AS sha256, CASE WHEN id % 3 <> 0 THEN concat('e', id) END AS error FROM files",
    ),
    "requested_model": Query(("models",), lambda m: library.default_model(m, 5), "SELECT id, name FROM models WHERE enabled ORDER BY id = 5 DESC, is_default DESC, id LIMIT 1"),
    "size_labels": Query(
        ("files",),
        lambda f: f.select("id", display.size_label(F.expr(SIZE)).alias("label")),
        f"""WITH s AS (SELECT id, {SIZE} AS n, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 ELSE 4 END AS p, n / (1024::DOUBLE ** p) AS v FROM files)
        SELECT id, concat(CASE WHEN p = 0 THEN n::VARCHAR WHEN v < 10 THEN round(v, 1)::DECIMAL(20, 1)::VARCHAR ELSE round(v)::DECIMAL(20, 0)::VARCHAR END, [' B', ' KB', ' MB', ' GB', ' TB'][p + 1]) AS label FROM s""",
    ),
    "duration_labels": Query(
        ("files",),
        lambda f: f.select("id", display.duration_label((F.col("size_bytes") / 200).cast("long")).alias("label")),
        """WITH s AS (SELECT id, size_bytes // 200 AS s, floor(s / 60 + 0.5)::BIGINT AS m FROM files)
        SELECT id, CASE WHEN s < 60 THEN 'under a minute' WHEN m < 60 THEN concat('about ', m, ' minute', CASE WHEN m = 1 THEN '' ELSE 's' END)
        ELSE concat('about ', m // 60, ' h', CASE WHEN m % 60 > 0 THEN concat(' ', m % 60, ' min') ELSE '' END) END AS label FROM s""",
    ),
    "age_labels": Query(
        ("heartbeats",),
        lambda h: h.select("id", display.age_label(F.when(F.col("value").isNotNull(), F.col("seen_at")), F.expr("TIMESTAMP '2024-01-15 00:00:00'")).alias("label")),
        """WITH a AS (SELECT id, value, seen_at, floor(epoch(TIMESTAMP '2024-01-15 00:00:00'))::BIGINT - floor(epoch(seen_at))::BIGINT AS s FROM heartbeats)
        SELECT id, CASE WHEN value IS NULL THEN '—' WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN concat(s // 60, ' min ago') WHEN s < 86400 THEN concat(s // 3600, ' h ago') ELSE strftime(seen_at, '%-d %b %Y') END AS label FROM a""",
    ),
    "page_sections": Query(
        ("headed",),
        lambda h: h.groupBy(text.section_of(F.when(F.col("file_id") % 3 == 0, "page").when(F.col("file_id") % 3 == 1, "slide").otherwise("lines"), F.col("heading")).alias("section")).agg(F.count("*").alias("n")),
        "SELECT CASE WHEN file_id % 3 < 2 AND heading <> '' THEN heading END AS section, count(*) AS n FROM headed GROUP BY 1",
    ),
    "identifiers": Query(
        ("documents",),
        lambda d: d.select("id", F.explode(text.identifiers(F.col("text"))).alias("identifier")),
        "SELECT DISTINCT id, lower(unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}'))) AS identifier FROM documents",
    ),
    "linked_citations": Query(
        ("documents",),
        lambda d: d.select("id", F.md5(text.linked_markers(F.concat("text", F.lit(" [1] [x] [23]")))).alias("linked")),
        "SELECT id, md5(regexp_replace(text || ' [1] [x] [23]', '\\[([0-9]+)\\]', '[\\1](#cite-\\1)', 'g')) AS linked FROM documents",
    ),
}
