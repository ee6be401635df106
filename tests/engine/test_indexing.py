"""The folder source, and a folder kept indexed: what is read, what is written, and what a crash leaves."""

from __future__ import annotations

import os

import pytest

from lodestar.lineage import ensure_checkpoint_dir
from lodestar.operators import mutations
from lodestar.sources import folder_source, store, versions
from lodestar.sources.folders import list_folder, read_texts, texts_of
from lodestar.streaming import indexing
from lodestar.streaming.watch import new_files, run

MODEL = "multilingual-e5-small"


def write(folder, name, text, mtime=None):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    if mtime is not None:
        os.utime(path, (mtime, mtime))


def test_all_names_are_listed_and_read(spark, tmp_path):
    for name in ("_notes.md", "a b/ü_x.TXT", "a b/deep/.hidden.md", "~$lock.md", ".git/x.md", "plain.exe", "#1?.md"):
        write(tmp_path, name, name)
    assert sorted(r.rel_path for r in list_folder(spark, str(tmp_path)).collect()) == ["#1?.md", "_notes.md", "a b/ü_x.TXT"]
    assert [r.rel_path for r in list_folder(spark, str(tmp_path), recursive=False, groups=["md"]).orderBy("rel_path").collect()] == ["#1?.md", "_notes.md"]
    assert {r.text for r in read_texts(spark, f"file://{tmp_path}").collect()} >= {"_notes.md", "a b/ü_x.TXT", "#1?.md"}
    assert spark.read.format("folder").load(str(tmp_path)).count() == 7
    (tmp_path / "empty").mkdir()
    assert list_folder(spark, str(tmp_path / "empty")).count() == 0


def test_a_listing_is_planned_by_size():
    files = [folder_source.File(f"/{k}", str(k), size, k) for k, size in enumerate([10, 10, 1_000, 10, 10, 10, 95])]
    assert [[f.size for f in p.files] for p in folder_source.planned(files, 100, 3)] == [[10, 10], [1_000], [10, 10, 10], [95]]
    assert folder_source.planned([]) == []


def test_contents_come_one_file_a_batch(tmp_path):
    for k in range(3):
        write(tmp_path, f"{k}.md", "x" * k)
    files = folder_source.listed(str(tmp_path))
    assert [b.num_rows for b in folder_source.rows(str(tmp_path), files, True)] == [1, 1, 1]
    os.remove(tmp_path / "1.md")
    assert [b.column(4).to_pylist() for b in folder_source.rows(str(tmp_path), files, True)] == [[b""], [b"xx"]]


def test_new_and_changed_files_come_as_a_stream(spark, tmp_path):
    docs, seen = tmp_path / "docs", []
    write(docs, "_a.md", "x", 1_000)
    write(docs, "b.tmp", "x", 1_000)

    def read():
        query = run(new_files(spark, str(docs)), lambda batch, _: seen.extend(r.file_name for r in batch.collect()), str(tmp_path / "cp"), once=True)
        assert query.awaitTermination(120)
        found, seen[:] = sorted(seen), []
        return found

    assert read() == ["_a.md"]
    assert read() == []
    write(docs, "_a.md", "y", 2_000)
    write(docs, "c.md", "y", 2_000)
    assert read() == ["_a.md", "c.md"]


def chunks(spark, at):
    return sorted((r.file_id, r.ordinal, r.text or "", r.sha256) for r in store.searched_chunks(spark, f"{at}/chunks", MODEL).collect())


def records(spark, at):
    return sorted((r.rel_path, r.status, r.sha256) for r in mutations.held(spark, f"{at}/records", "file", indexing.RECORD).collect())


def index(spark, folder, at, **options):
    return indexing.index_folder(spark, str(folder), str(at), texts_of, MODEL, buckets=4, **options)


@pytest.fixture
def docs(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    folder = tmp_path / "docs"
    write(folder, "a.md", "# One\n\nThe first section has a sentence.\n\n# Two\n\nThe second one has another.", 1_000)
    write(folder, "b.txt", "Lines of a plain text file.\nAnd one more of them.", 1_000)
    write(folder, "empty.txt", "", 1_000)
    return folder


def test_only_what_has_changed_is_written(spark, docs, tmp_path):
    at = tmp_path / "store"
    assert index(spark, docs, at) == {"indexed": 3, "removed": 0}
    version = lambda: versions.latest(spark, f"{at}/chunks").version
    first, before = version(), chunks(spark, at)
    assert len({c[0] for c in before}) == 3 and sum(1 for c in before if c[2]) == 3
    assert index(spark, docs, at) == {"indexed": 0, "removed": 0} and version() == first
    write(docs, "b.txt", (docs / "b.txt").read_bytes(), 2_000)  # touched, but equal
    assert index(spark, docs, at) == {"indexed": 0, "removed": 0} and version() == first and chunks(spark, at) == before
    write(docs, "b.txt", "Another text altogether.", 3_000)
    os.remove(docs / "a.md")
    assert index(spark, docs, at) == {"indexed": 1, "removed": 1} and version() == first + 1
    assert [c[2] for c in chunks(spark, at) if c[2]] == ["Another text altogether."]
    assert [(p, s) for p, s, _ in records(spark, at)] == [("a.md", "deleted"), ("b.txt", "indexed"), ("empty.txt", "indexed")]
    write(docs, "a.md", "# Back\n\nThe file is here again.", 4_000)
    assert index(spark, docs, at) == {"indexed": 1, "removed": 0}
    assert records(spark, at)[0][1] == "indexed"
    assert index(spark, docs, at, index_version=99) == {"indexed": 3, "removed": 0}


@pytest.mark.parametrize("dies_in", ["chunks", "between", "records"])
def test_killed_and_restarted(spark, docs, tmp_path, monkeypatch, dies_in):
    """A stream that dies in a batch and is started again leaves what one batch build leaves."""
    at = tmp_path / "store"
    ticks = tmp_path / "ticks"
    tick = lambda n: spark.createDataFrame([(str(docs), n)], "folder string, n int").coalesce(1).write.parquet(f"{ticks}/{n}")
    tick(1)
    stream = lambda: spark.readStream.schema("folder string, n int").option("recursiveFileLookup", "true").parquet(str(ticks))
    go = lambda: indexing.keep_indexed(stream(), str(at), str(tmp_path / "cp"), texts_of, MODEL, buckets=4)
    assert go().awaitTermination(300)
    write(docs, "b.txt", "A changed text.", 5_000)
    write(docs, "new.md", "# New\n\nA file that was not there.", 5_000)
    os.remove(docs / "a.md")
    tick(2)
    put, publish = mutations.put, versions._publish
    with monkeypatch.context() as m:
        def dies(*args, **kwargs):
            raise RuntimeError("killed")

        if dies_in == "chunks":
            m.setattr(versions, "_publish", lambda spark, path, *rest: dies() if path.endswith("chunks") else publish(spark, path, *rest))
        elif dies_in == "between":
            m.setattr(mutations, "put", dies)
        else:
            m.setattr(mutations, "put", lambda *a, **k: (put(*a, **k), dies()))
        with pytest.raises(Exception, match="killed"):
            go().awaitTermination(300)
    write(docs, "b.txt", "Changed once more while nothing ran.", 6_000)
    assert go().awaitTermination(300)
    index(spark, docs, tmp_path / "built")
    assert chunks(spark, at) == chunks(spark, tmp_path / "built")
    assert [r for r in records(spark, at) if r[1] == "indexed"] == records(spark, tmp_path / "built")
    assert [r[0] for r in records(spark, at) if r[1] == "deleted"] == ["a.md"]
    assert versions.latest(spark, f"{at}/records").batch(f"indexing:{docs}") == 1
