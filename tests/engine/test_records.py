"""Lives of files, sessions, roots and labels: literal expectations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lodestar.functions import display
from lodestar.operators import records, work_queue

T = datetime(2024, 1, 1)


def test_states_after_events(spark):
    files = spark.createDataFrame([(1, "queued"), (2, "processing"), (3, "indexed"), (4, "deleted"), (5, "queued"), (6, "failed")], "id int, status string")
    said = {1: "indexed claimed failed", 2: "indexed claimed failed", 3: "claimed failed requeued claimed", 4: "claimed requeued", 5: "claimed removed indexed", 6: ""}
    events = spark.createDataFrame([(f, T, i, e) for f, text in said.items() for i, e in enumerate(text.split())], "file_id int, happened_at timestamp, id int, event string")
    assert dict(records.after_events(files, events).collect()) == {1: "failed", 2: "indexed", 3: "processing", 4: "queued", 5: "deleted", 6: "failed"}
    assert dict(records.after_events(files, events.limit(0)).collect())[2] == "processing"


def test_roots_end_at_folders(spark):
    paths = spark.createDataFrame([(1, "srv/docs/a/b.md"), (2, "srv/docs2/c.md"), (3, "home/d.md"), (4, "srv/docs"), (5, None)], "id int, path string")
    roots = spark.createDataFrame([("srv",), ("srv/docs",), ("srv/docs",)], "path string")
    found = {r.id: (r.root, r.below) for r in records.roots_of(paths, roots).collect()}
    assert found == {1: ("srv/docs", "a/b.md"), 2: ("srv", "docs2/c.md"), 3: (None, None), 4: ("srv/docs", ""), 5: (None, None)}


def test_only_owners_delete(spark):
    messages = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0)], "conv_id int, turn int")
    owners = spark.createDataFrame([(1, 7), (2, 8), (3, 7)], "conv_id int, user_id int")
    asked = spark.createDataFrame([(1, 7), (2, 7), (9, 9)], "conv_id int, user_id int")
    assert sorted(r.conv_id for r in records.without_conversations(messages, owners, asked).collect()) == [2, 3]


def test_sessions(spark):
    logins = spark.createDataFrame([("a", 1, datetime(2024, 1, 1)), ("b", 1, datetime(2024, 1, 10)), ("c", 2, datetime(2024, 1, 10)), ("d", 3, datetime(2024, 1, 10))], "id string, user_id int, happened_at timestamp")
    users = spark.createDataFrame([(1, "user", True), (2, "admin", False), (3, "user", True)], "id int, role string, active boolean")
    sessions = records.start_sessions(logins)
    assert {r.id: r.expires_at for r in sessions.collect()}["a"] == datetime(2024, 1, 15)
    ended = spark.createDataFrame([("d",)], "id string")
    assert [r.id for r in records.session_users(sessions, ended, users, F.lit(datetime(2024, 1, 15))).collect()] == ["b"]
    assert dict(records.last_logins(users, logins.where("user_id = 1")).collect()) == {1: datetime(2024, 1, 10), 2: None, 3: None}


def test_lanes_take_what_is_free(spark):
    rows = [(1, "doc", "running"), (2, "doc", "queued"), (3, "doc", "queued"), (4, "media", "running"), (5, "media", "queued"), (6, "system", "queued"), (7, "system", "queued"), (8, "other", "queued")]
    jobs = spark.createDataFrame([(i, lane, s, 0, 0, T) for i, lane, s in rows], "id int, lane string, status string, priority int, attempts int, run_after timestamp")
    widths = {"doc": 2, "media": 1, "system": 1}
    assert sorted(r.id for r in work_queue.claim(jobs, F.lit(T), widths).collect()) == [2, 6, 8]
    assert sorted(r.id for r in work_queue.claim(jobs, F.lit(T)).collect()) == [2, 5, 6, 8]


def test_labels_for_people(spark):
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (10 * 1024,), (1024**2 * 3 // 2,), (1024**4 * 2048,), (None,)], "n long")
    assert [r[0] for r in sizes.select(display.size_label(F.col("n"))).collect()] == ["0 B", "1023 B", "1.0 KB", "10 KB", "1.5 MB", "2048 TB", None]
    times = spark.createDataFrame([(59,), (60,), (150,), (3_600,), (9_000,)], "s long")
    assert [r[0] for r in times.select(display.duration_label(F.col("s"))).collect()] == ["under a minute", "about 1 minute", "about 3 minutes", "about 1 h", "about 2 h 30 min"]
    then = spark.createDataFrame([(None,), (datetime(2024, 1, 1, 11, 59, 30),), (datetime(2024, 1, 1, 11, 1),), (datetime(2024, 1, 1, 3),), (datetime(2023, 12, 5),)], "at timestamp")
    assert [r[0] for r in then.select(display.age_label(F.col("at"), F.lit(datetime(2024, 1, 1, 12)))).collect()] == ["—", "just now", "59 min ago", "9 h ago", "5 Dec 2023"]
