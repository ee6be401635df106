"""Sources, search, queue and streams on small fixtures."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions.files import allowed_extensions, extension, find_root, ignored_name, kind_of, normal_path
from lodestar.functions.vectors import hashed_counts
from lodestar.operators import search
from lodestar.operators import work_queue as queue
from lodestar.sources.folders import decode, list_folder, read_texts
from lodestar.sources.segments import markdown_sections, text_windows
from lodestar.sources.store import embed_missing, rebucketed, searched_chunks, swap_chunks, text_hash
from lodestar.sources.versions import latest
from lodestar.streaming.stability import gate
from lodestar.streaming.watch import new_files, run, scans


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


def test_text_windows_and_markdown(spark):
    df = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(1, 131))), (2, ""), (3, "\n" * 70 + "x")], "id int, text string")
    assert sorted((r.id, r.line_start, r.line_end) for r in text_windows(df).collect()) == [(1, 1, 60), (1, 61, 120), (1, 121, 130), (3, 61, 71)]
    note = spark.createDataFrame([(1, "# One\na\nb\n## Two ##\nc\nd\n"), (2, "before\n# H\n")], "id int, text string")
    got = sorted((r.id, r.loc_type, r.heading, r.line_start, r.line_end) for r in markdown_sections(note).collect())
    assert got == [(1, "heading", "One", 1, 3), (1, "heading", "Two", 4, 6), (2, "heading", "H", 2, 2), (2, "lines", None, 1, 1)]


def test_scalar_functions(spark):
    c = F.col
    assert one(spark, T.section_title(c("s")), s="3 Authentication › 3.1 RequestToken") == "Authentication › Request Token"
    assert one(spark, T.timestamp_label(c("s")), s=3725.9) == "1:02:05" and one(spark, T.timestamp_label(c("s")), s=65.0) == "1:05"
    assert one(spark, T.source_header(c("f"), c("l"), c("s")), f="a.pdf", l="Page 2", s="1 X") == "[Source: a.pdf | Page 2 | 1 X]"
    assert one(spark, T.has_content(c("t")), t="6") is False and one(spark, T.has_content(c("t")), t="Q3 Revenue: 4.2M") is True
    assert one(spark, T.has_content(c("t"), c("h")), t="2 Common  Methods", h="1 A › 2 Common Methods") is False
    questions = {"What is LedgerPay?": True, "Tell me about the portal": True, "overview of billing": True, "What is the error response?": False, "How do I log in?": False}
    assert {q: one(spark, T.is_definitional(c("q")), q=q) for q in questions} == questions
    assert one(spark, T.without_thoughts(c("t")), t="<think>no\n</think> yes") == "yes"
    assert one(spark, T.linked_markers(c("t")), t="a [2]") == "a [2](#cite-2)"
    assert one(spark, T.snippet(c("t")), t="[Screenshot text] " + "word " * 100) == ("word " * 52).strip() + "…"


def test_file_names(spark):
    names = {"a.PDF": ("pdf", ".pdf", False), ".hidden": (None, "", True), "~$x.docx": ("office", ".docx", True), "n": (None, "", False), "b.tar.md": ("text", ".md", False), "c.txt.part": (None, ".part", True)}
    for name, (kind, ext, ignored) in names.items():
        got = spark.range(1).select(F.lit(name).alias("n")).select(kind_of(F.col("n")), extension(F.col("n")), ignored_name(F.col("n"))).first()
        assert tuple(got) == (kind, ext, ignored), name
    assert allowed_extensions(["pdf", "md", "exe"]) == [".md", ".pdf"] and len(allowed_extensions(None)) == 11
    assert normal_path("C:\\Docs\\x") == ("c:", ("Docs", "x"))
    assert find_root("c:/docs/Sub/a.txt", ["C:/Docs", "C:/docs/sub"]) == ("C:/docs/sub", "a.txt")
    assert find_root("/srv/a", ["/data"]) is None
    with pytest.raises(ValueError):
        normal_path("/a/../b")


def test_folder_and_decoding(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".git").mkdir()
    for name, raw in {"a.pdf": b"x", "sub/b.pdf": b"xx", "c.md": "é".encode(), "d.exe": b"", "~$e.docx": b"", ".git/f.txt": b"g"}.items():
        (tmp_path / name).write_bytes(raw)
    assert sorted(r.rel_path for r in list_folder(spark, str(tmp_path)).collect()) == ["a.pdf", "c.md", "sub/b.pdf"]
    assert sorted(r.rel_path for r in list_folder(spark, str(tmp_path), recursive=False, groups=["pdf"]).collect()) == ["a.pdf"]
    assert {r.text for r in read_texts(spark, str(tmp_path)).collect()} == {"é"}
    assert decode("é".encode("utf-16")) == "é" and decode(b"\xe9") == "é" and decode(b"\x81") == "\x81" and decode(b"\xef\xbb\xbfx") == "x"


def corpus(spark):
    rows = [(1, 1, None, "Approve the purchase order in the procurement module"), (2, 2, None, "Payroll salary statements are exported every month")]
    rows += [(10 + k, 3, t, "same body of text for all sections of this reference") for k, t in enumerate(["1 Authentication", "2 Billing", "3 Reporting", "4 Shipping", "5 Printing", "6 Archive overview"])]
    passages = spark.createDataFrame(rows, "chunk long, project int, heading string, text string")
    own = hashed_counts(passages, "chunk", "text", 1024).withColumnRenamed("id", "chunk")
    titles = hashed_counts(passages.where("heading IS NOT NULL").select("chunk", T.section_title(F.col("heading")).alias("t")), "chunk", "t", 1024).withColumnsRenamed({"id": "chunk", "counts": "heading_counts"})
    return passages.join(own, "chunk").join(titles, "chunk", "left")


def ask(spark, *texts):
    q = spark.createDataFrame(list(enumerate(texts)), "question int, text string")
    return q.join(hashed_counts(q, "question", "text", 1024).withColumnRenamed("id", "question"), "question")


def test_projects_restrict_every_list(spark):
    p, q = corpus(spark), ask(spark, "approve purchase order procurement", "authentication", "what is the archive overview")
    files = p.select(F.col("chunk").alias("file"), F.lit("indexed").alias("status"))
    assert {r.chunk for r in search.retrieve(p, q, files, 1024, projects=[3]).collect()} <= set(range(10, 16))
    assert {r.chunk for r in search.retrieve(p, q, files, 1024, projects=[1, 2]).collect()} == {1, 2}
    assert search.retrieve(p, q, files, 1024, projects=[]).count() == 0


def test_questions_beyond_one_matrix(spark, monkeypatch):
    p, q = corpus(spark), ask(spark, *[f"approve {w} order" for w in ("purchase", "salary", "archive", "billing", "payroll", "procurement")])
    few = sorted(map(tuple, search.vector_hits(p, q, 1024, 3).collect()))
    monkeypatch.setattr("lodestar.functions.vectors.MATRIX_BYTES", 2 * 1024 * 8)
    assert sorted(map(tuple, search.vector_hits(p, q, 1024, 3).collect())) == few
    hits = sorted(map(tuple, search.keyword_hits(p, q).collect()))
    monkeypatch.setattr(search, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, search.keyword_hits(p, q).collect())) == hits


def test_coverage_gate_and_sections(spark):
    p = corpus(spark)
    q = ask(spark, "approve purchase order procurement unicorn", "is it of", "authentication", "payroll weather tomorrow sunshine")
    hits = search.keyword_hits(p, q)
    assert hits.where("question = 0 AND chunk = 1").first().score == 0.8
    assert hits.where("question = 1").count() == 0
    sections = search.section_hits(p, q, 1024).collect()
    assert {(r.question, r.chunk) for r in sections} == {(2, 10)}
    relevant = {r.question: r.relevant for r in search.gate(q, search.vector_hits(p, q, 1024), hits, 0.45).collect()}
    assert relevant == {0: True, 1: False, 2: False, 3: False}
    fused = search.fuse(search.ranked_lists(p, q, 1024)).where("rank = 1").collect()
    assert {r.question: r.chunk for r in fused}[0] == 1 and {r.question: r.chunk for r in fused}[2] == 10


def test_hashed_counts_any_size(spark):
    import hashlib

    df = spark.createDataFrame([(1, "alpha beta beta go"), (2, ""), (3, None)], "id int, text string")
    for dim in (64, 384, 1024):
        got = {r.id: r.counts for r in hashed_counts(df, "id", "text", dim).collect()}
        want = [0.0] * dim
        for w in ("alpha", "beta", "beta"):
            want[int(hashlib.md5(w.encode()).hexdigest(), 16) % dim] += 1
        assert got[1] == want and got[2] == got[3] == [1.0] + [0.0] * (dim - 1)


def test_queue(spark):
    now = F.expr("TIMESTAMP '2024-01-01 12:00:00'")
    t = dt.datetime(2024, 1, 1, 11, 0)
    rows = [(1, "doc", "queued", 1, 0, 3, "a", t, t), (2, "doc", "running", 5, 1, 3, "a", t, t), (3, "doc", "running", 5, 3, 3, "b", t, t), (4, "doc", "running", 5, 1, 3, None, t, t), (5, "doc", "queued", 9, 0, 3, "c", t, t), (6, "media", "queued", 0, 0, 3, None, t, t)]
    jobs = spark.createDataFrame(rows, "id int, lane string, status string, priority int, attempts int, max_attempts int, dedupe_key string, run_after timestamp, heartbeat_at timestamp")
    assert {r.lane: r.id for r in queue.claim(jobs, now).collect()} == {"doc": 5, "media": 6}
    assert {r.id: r.new_status for r in queue.reap(jobs, now).collect()} == {2: "cancelled", 3: "failed", 4: "queued"}
    new = spark.createDataFrame([(10, "a"), (11, "z"), (12, "z"), (13, None), (14, None)], "id int, dedupe_key string")
    assert sorted(r.id for r in queue.enqueue(jobs, new).collect()) == [11, 13, 14]


def test_stability_stream(spark, tmp_path):
    rows = [(1, 5, 1.0, 0.0, False), (1, 5, 1.0, 4.0, False), (1, 6, 1.0, 6.0, False), (1, 6, 1.0, 15.9, False), (1, 6, 1.0, 16.0, False), (2, 1, 1.0, 3.0, True)]
    schema = "file_id long, size_bytes long, mtime double, seen_at double, forced boolean"
    for k, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = gate(stream, 10).writeStream.format("memory").queryName("ready_files").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {(r.file_id, r.seen_at): r.ready for r in spark.table("ready_files").collect()}
    assert got == {(1, 0.0): False, (1, 4.0): False, (1, 6.0): False, (1, 15.9): False, (1, 16.0): True, (2, 3.0): True}


def test_watch_streams(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("x")
    (tmp_path / "docs/b.tmp").write_text("x")
    seen = []
    query = run(new_files(spark, str(tmp_path / "docs")), lambda batch, _: seen.extend(r.file_name for r in batch.collect()), str(tmp_path / "cp1"), once=True)
    assert query.awaitTermination(120) and seen == ["a.md"]
    t = dt.datetime(2024, 1, 1)
    events = [(1, t + dt.timedelta(seconds=s)) for s in (0, 1, 2.5, 60)] + [(2, t), (9, t + dt.timedelta(days=1))]
    spark.createDataFrame(events, "folder_id long, seen_at timestamp").coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = scans(spark.readStream.schema("folder_id long, seen_at timestamp").parquet(str(tmp_path / "events")))
    query = stream.writeStream.format("memory").queryName("due_scans").option("checkpointLocation", str(tmp_path / "cp2")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted((r.folder_id, r.n_events) for r in spark.table("due_scans").collect()) == [(1, 1), (1, 3), (2, 1)]


def test_stores(spark, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    path = str(tmp_path / "chunks")
    make = lambda rows: spark.createDataFrame(rows, "file_id long, ordinal int, text string")
    rows = lambda at: sorted((r.file_id, r.text) for r in searched_chunks(spark, at).collect())
    swap_chunks(spark, path, make([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]), make([(1, 0, ""), (2, 0, "")]))
    swap_chunks(spark, path, make([(1, 0, "new")]), make([(1, 0, "")]))
    assert rows(path) == [(1, "new"), (2, "c")]
    swap_chunks(spark, path, make([]), make([(2, 0, "")]))
    assert rows(path) == [(1, "new")]
    rebucketed(spark, path, other := str(tmp_path / "more"), 1_000)
    swap_chunks(spark, other, make([(3, 0, "d"), (4, 0, "e")]), make([(3, 0, ""), (4, 0, "")]))
    assert rows(other) == [(1, "new"), (3, "d"), (4, "e")] and latest(spark, other).doc["buckets"] == 1_000
    swap_chunks(spark, path, make([]), make([(1, 0, "")]))
    swap_chunks(spark, path, make([(5, 0, "f")]), make([(5, 0, "")]))
    assert rows(path) == [(5, "f")]
    passages = spark.createDataFrame([("x",), ("x",), ("y",), ("z",)], "passage string")
    cache = spark.createDataFrame([("z",)], "passage string").select(text_hash("m").alias("text_hash"))
    assert sorted(r.passage for r in embed_missing(passages, cache, "m", lambda rows: rows).collect()) == ["x", "y"]
