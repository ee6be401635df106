"""The graph index against the comparison with all rows."""

from __future__ import annotations

import numpy as np
import pytest

from lodestar.lineage import ensure_checkpoint_dir
from lodestar.operators import search
from lodestar.sources import store, vector_index

SCHEMA = "file_id long, chunk long, project int, counts array<double>"


def data(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    x = centres[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, dim))
    rows = [(int(i // 2), int(3 * i), int(i % 5), x[i].tolist()) for i in range(n)]
    return [*rows, (n, 3 * n, 0, None), (n + 1, 3 * n + 3, 1, [0.0] * dim), (n + 2, 3 * n + 6, 1, rows[0][3])]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    ensure_checkpoint_dir(spark)
    folder = tmp_path_factory.mktemp("graph")
    rows = spark.createDataFrame(data(6_000), SCHEMA).cache()
    store.swap_chunks(spark, str(folder / "s"), rows, rows, buckets=3)
    vector_index.refresh(spark, str(folder / "s"), str(folder / "i"))
    rng = np.random.default_rng(9)
    asked = [(f"q{i}", (np.array(v) + 0.3 * rng.normal(size=16)).tolist()) for i, (_, _, _, v) in enumerate(data(60, seed=0)[:60])]
    asked += [(f"far{i}", np.abs(rng.normal(size=16)).tolist()) for i in range(40)]
    return folder, rows, spark.createDataFrame([*asked, ("none", None), ("zero", [0.0] * 16)], "question string, counts array<double>")


def by_question(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.question, {})[r.chunk] = (r.score, r["rank"])
    return out


def exactly(rows, asked, **options):
    hits = search.vector_hits(rows, asked.where("question NOT IN ('none', 'zero')"), 16, **options).where("score IS NOT NULL")
    return by_question(hits.select("question", "chunk", "score", "rank"))


@pytest.mark.parametrize("beam", [40, 320])
@pytest.mark.parametrize("projects", [None, [1, 2, 3, 4], [2]])
def test_recall(spark, made, beam, projects):
    folder, rows, asked = made
    got = by_question(vector_index.search(spark, str(folder / "i"), asked, beam=beam, projects=projects))
    expected = exactly(rows if projects is None else rows.where(rows.project.isin(projects)), asked)
    assert set(got) == set(expected) and all(len(got[q]) == 40 for q in got)
    recall = [len(set(got[q]) & set(expected[q])) / 40 for q in expected]
    assert np.mean(recall) >= (0.9 if beam == 40 else 0.99) and (beam == 40 or min(recall) >= 0.9)
    assert all(got[q][c][0] == expected[q][c][0] for q in got for c in set(got[q]) & set(expected[q]))


def test_exact_way(spark, made, monkeypatch):
    folder, rows, asked = made
    assert by_question(vector_index.search(spark, str(folder / "i"), asked, exact=True)) == exactly(rows, asked)
    monkeypatch.setattr(vector_index, "MATRIX_BYTES", 2_000)  # questions in several blocks
    assert by_question(vector_index.search(spark, str(folder / "i"), asked, 5, exact=True, projects=[0])) == exactly(rows.where("project = 0"), asked, k=5)
    assert by_question(vector_index.search(spark, str(folder / "i"), asked, projects=[])) == {}


def test_covers_every_row_and_opens_few(spark, made):
    folder, rows, _ = made
    snapshot = vector_index.versions.latest(spark, str(folder / "i"))
    held = vector_index.rows(spark, snapshot)
    assert held.count() == rows.count() and held.where("links IS NOT NULL").count() == rows.count() - 2
    x = np.array([v for _, _, _, v in data(6_000)[:6_000]])
    shard = vector_index.Shard(np.arange(6_000), np.zeros(6_000), x, vector_index.graph_of(vector_index._units(x)))
    reached, front = {0}, [0]
    while front:
        front = [j for i in front for j in shard.links[i].tolist() if j >= 0 and j not in reached and not reached.add(j)]
    assert len(reached) == 6_000
    shard.walk(vector_index._units(x[:50]), np.ones(6_000, bool), 10, 40)
    assert shard.opened < 50 * 6_000 / 4


def test_kept_up_to_date_by_file(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    rows = spark.createDataFrame(data(300), SCHEMA)
    chunk_store, index = str(tmp_path / "s"), str(tmp_path / "i")
    store.swap_chunks(spark, chunk_store, rows, rows, buckets=8)
    first = vector_index.refresh(spark, chunk_store, index)
    assert vector_index.refresh(spark, chunk_store, index).version == first.version
    new = spark.createDataFrame([(0, 9_999, 7, [1.0] * 16)], SCHEMA)
    store.swap_chunks(spark, chunk_store, new, new)
    second = vector_index.refresh(spark, chunk_store, index)
    assert sum(second.generation()["parts"][b] != p for b, p in first.generation()["parts"].items()) == 1
    asked = spark.createDataFrame([(1, [1.0] * 16)], "question long, counts array<double>")
    assert vector_index.search(spark, index, asked, 1).first()["chunk"] == 9_999
    assert vector_index.search(spark, first, asked, 1).first()["chunk"] != 9_999
    assert vector_index.search(spark, index, asked, 5, projects=[7]).count() == 1


@pytest.mark.parametrize("n", [1, 2, 3, 60])
def test_small_shards(n):
    x = np.random.default_rng(n).normal(size=(n, 4))
    links = vector_index.graph_of(vector_index._units(x))
    assert len(links) == n and all(i not in f.tolist() for i, f in enumerate(links))
    shard = vector_index.Shard(np.arange(n), np.zeros(n), x, links)
    assert set(shard.walk(vector_index._units(x[:1]), np.ones(n, bool), n, n + 1)[0].tolist()) - {-1} == set(range(n))


def test_copies_are_found_like_other_rows(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    rows = spark.createDataFrame([(i, i, i % 5, (x[i % 600] * (1 + i // 600 % 2)).tolist()) for i in range(600 * 30)], SCHEMA).cache()
    chunk_store, index = str(tmp_path / "s"), str(tmp_path / "i")
    store.swap_chunks(spark, chunk_store, rows, rows, buckets=2)
    vector_index.refresh(spark, chunk_store, index)
    asked = spark.createDataFrame([(f"q{i}", (x[i] + 0.5 * rng.normal(size=16)).tolist()) for i in range(40)], "question string, counts array<double>")
    assert by_question(vector_index.search(spark, index, asked)) == exactly(rows, asked)
    assert by_question(vector_index.search(spark, index, asked, projects=[2])) == exactly(rows.where("project = 2"), asked)
    assert by_question(vector_index.search(spark, index, asked, exact=True)) == exactly(rows, asked)


def test_a_store_of_more_rows_has_more_shards(spark, monkeypatch):
    from lodestar.plans import stores

    monkeypatch.setattr(stores, "VECTORS_A_SHARD", 100)
    rows = spark.createDataFrame([(i, i % 5, v) for i, _, _, v in data(2_000)[:2_000]], "id long, project int, embedding array<double>")
    found = vector_index.versions.latest(spark, stores.graph(rows))
    held = vector_index.rows(spark, found).groupBy("bucket").count().agg({"count": "max"}).first()[0]
    assert found.doc["buckets"] == 20 and held < 1_000
