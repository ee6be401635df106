"""Changes that last: what one commit holds, what is refused, what the audit says."""

from __future__ import annotations

import json

import pytest

from lodestar.operators import mutations as M
from lodestar.sources import versions


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "records")


def rows(spark, path, entity, schema, version=None):
    return sorted((r.asDict() for r in M.held(spark, path, entity, schema, version).collect()), key=lambda r: str(r["id"]))


def audited(spark, path, after=0):
    return sorted((r.action, r.entity, r.entity_id) for r in M.audit(spark, path, after).collect())


def test_settings(spark, path):
    assert M.settings(spark, path)["whisper_model"] == "small" and M.settings(spark, path)["rescan_interval_seconds"] is None
    for bad in ({"rescan_interval_seconds": 29}, {"rescan_interval_seconds": 86_401}, {"whisper_model": "huge"}, {"whisper_model": "tiny", "rescan_interval_seconds": 0}):
        with pytest.raises(M.Refused):
            M.change_settings(spark, path, bad)
    assert versions.latest(spark, path) is None  # nothing was written
    M.change_settings(spark, path, {"rescan_interval_seconds": 30, "whisper_model": "medium", "setup_completed": None}, user=7)
    M.change_settings(spark, path, {"rescan_interval_seconds": 86_400})
    M.change_settings(spark, path, {"rescan_interval_seconds": None})
    assert M.settings(spark, path) == {"setup_completed": "false", "rescan_interval_seconds": "86400", "whisper_model": "medium", "index_embedding_model": None}
    last = [r for r in M.audit(spark, path, after=1).collect()]
    assert [(r.action, r.entity, r.entity_id, json.loads(r.before)["value"], json.loads(r.after)["value"]) for r in last] == [("update", "settings", "rescan_interval_seconds", "30", "86400")]


def test_folders(spark, path):
    new = spark.createDataFrame([("/srv/a/docs", "", True), ("/srv/b", "Books", False), ("/srv/b", "Zoo", True), ("/srv/c/", None, None)], "path string, display_name string, enabled boolean")
    assert {r.path: r.display_name for r in M.create_folders(spark, path, new, user=1).collect()} == {"/srv/a/docs": "docs", "/srv/b": "Books", "/srv/c/": "c"}
    ids = {r["path"]: r["id"] for r in rows(spark, path, "folder", M.FOLDER)}
    a, b, c = ids["/srv/a/docs"], ids["/srv/b"], ids["/srv/c/"]
    assert versions.latest(spark, path).version == 1  # folders, projects, scans and the mark in one commit
    assert {(p["folder_id"], p["name"]) for p in rows(spark, path, "project", M.PROJECT)} == {(a, "docs"), (b, "Books"), (c, "c")}
    assert {j["folder_id"] for j in rows(spark, path, "job", M.JOB)} == {a, c} and M.settings(spark, path)["setup_completed"] == "true"
    assert M.create_folders(spark, path, new).isEmpty() and versions.latest(spark, path).version == 1

    files = spark.createDataFrame([(1, a, "x.md", "h1"), (2, a, "y.md", "h2"), (3, b, "z.md", "h3")], M.FILE)
    sub = spark.createDataFrame([(77, b, b, "Part of Books")], M.PROJECT)
    M.put(spark, path, [M.records(files, "file"), M.records(sub, "project")])
    changes = spark.createDataFrame([(a, None, "/srv/new", None), (b, "Library", "/srv/b", True), (12345, "nobody", None, None)], "id long, display_name string, path string, enabled boolean")
    assert sorted(r.id for r in M.update_folders(spark, path, changes).collect()) == [1, 2]
    assert [f["id"] for f in rows(spark, path, "file", M.FILE)] == [3]
    after = {f["id"]: f for f in rows(spark, path, "folder", M.FOLDER)}
    assert after[a]["path"] == "/srv/new" and after[a]["last_scan_at"] is None and after[b]["display_name"] == "Library" and after[b]["enabled"] and after[c]["display_name"] == "c"
    assert {p["id"]: p["name"] for p in rows(spark, path, "project", M.PROJECT)} == {a: "docs", b: "Library", c: "c", 77: "Part of Books"}
    assert {j["folder_id"] for j in rows(spark, path, "job", M.JOB)} == {a, b, c}
    assert audited(spark, path, after=2) == sorted([("delete", "file", "1"), ("delete", "file", "2"), ("update", "folder", str(a)), ("update", "folder", str(b)), ("update", "project", str(b)), ("create", "job", f"scan:{b}")])


def test_answers_and_their_cards_are_one_commit(spark, path):
    talks = spark.createDataFrame([(1, "t", None), (2, "u", 5)], M.CONVERSATION)
    M.put(spark, path, [M.records(talks, "conversation")])
    card = "marker int, chunk_id long, file_id long, file_name string, label string, page int, snippet string, cited boolean"
    answers = spark.createDataFrame(
        [(10, 1, "yes [1]", "ok", 3, 120, [(1, 100, 7, "a.pdf", "Page 1", 1, "s", True), (2, 101, 8, "b.pdf", "Page 2", 2, "t", False)]), (11, 2, "no", "not_found", 3, 80, []), (12, 9, "late", "ok", 3, 5, [(1, 1, 7, "a", "l", 1, "s", True)])],
        f"id long, conversation_id long, content string, status string, model_id long, latency_ms long, cards array<struct<{', '.join(x.strip().replace(' ', ':') for x in card.split(','))}>>",
    )
    files = spark.createDataFrame([(7, "sha7")], "id long, sha256 string")
    assert sorted(r.id for r in M.save_answers(spark, path, answers, files).collect()) == [10, 11]
    assert versions.latest(spark, path).version == 2
    assert [(m["id"], m["role"], m["content"]) for m in rows(spark, path, "message", M.MESSAGE)] == [(10, "assistant", "yes [1]"), (11, "assistant", "no")]
    assert [(c["id"], c["sha256"], c["cited"]) for c in rows(spark, path, "card", M.CARD)] == [("10/1", "sha7", True), ("10/2", None, False)]
    assert {c["id"]: c["last_message"] for c in rows(spark, path, "conversation", M.CONVERSATION)} == {1: 10, 2: 11}
    # the file changes later: the card keeps the digest it had; a version before the answer has neither message nor card
    M.put(spark, path, [M.records(spark.createDataFrame([(7, 1, "a.pdf", "sha7b")], M.FILE), "file")])
    assert rows(spark, path, "card", M.CARD)[0]["sha256"] == "sha7"
    assert rows(spark, path, "message", M.MESSAGE, 1) == rows(spark, path, "card", M.CARD, 1) == []
