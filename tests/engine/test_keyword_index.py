"""The inverted index against the search that reads all texts."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lodestar.functions.stemming import stemmed
from lodestar.functions.text import lexemes
from lodestar.lineage import ensure_checkpoint_dir
from lodestar.operators import search
from lodestar.sources import keyword_index, store

SCHEMA = "file_id long, chunk long, project int, heading string, text string"


def passages(rng, n, start=0):
    words = [f"word{k}" for k in range(40)] + ["the", "HttpClient", "über", "日本", "x1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    out = []
    for i in range(start, start + n):
        text = " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 40])))
        heading = rng.choice([None, "", " ".join(rng.choices(words, k=2))])
        out.append((i // 3, i * 7 - 5, i % 4, heading, rng.choice([None, text, text, text])))
    return out


QUESTIONS = [(1, "word0 word1"), (2, "word39 word0"), (3, "the of and"), (4, ""), (5, None), (6, "http client über unknownword"), (7, "word3 word3 word3"), (8, " ".join(f"word{k}" for k in range(40))), (9, "日本 x1 word20 word30")]


def everything(spark, rows, questions, k=search.CANDIDATES, lexed=lexemes):
    return sorted(tuple(r) for r in search.keyword_hits(spark.createDataFrame(rows, SCHEMA), questions, k, lexed).select("question", "chunk", "score", "density", "rank").collect())


def looked_up(spark, path, questions, *args, **options):
    return sorted(tuple(r) for r in keyword_index.search(spark, path, questions, *args, **options).select("question", "chunk", "score", "density", "rank").collect())


@pytest.fixture
def asked(spark):
    return spark.createDataFrame(QUESTIONS, "question long, text string")


@pytest.mark.parametrize("k", [1, 40])
@pytest.mark.parametrize(("block", "summed"), [(2, 0), (2, 50), (128, 1 << 17)])
def test_finds_what_a_search_of_all_texts_finds(spark, asked, tmp_path, monkeypatch, k, block, summed):
    ensure_checkpoint_dir(spark)
    monkeypatch.setattr(keyword_index, "BLOCK", block)
    monkeypatch.setattr(keyword_index, "AT_ONCE", 1)
    monkeypatch.setattr(keyword_index, "SUMMED", summed)
    rows = passages(random.Random(k + block), 600)
    chunks = spark.createDataFrame(rows, SCHEMA)
    chunk_store, index = str(tmp_path / "s"), str(tmp_path / "i")
    store.swap_chunks(spark, chunk_store, chunks, chunks, buckets=3)
    keyword_index.refresh(spark, chunk_store, index, lexes=8)
    assert looked_up(spark, index, asked, k) == everything(spark, rows, asked, k)
    for projects in ([1, 3], [2], [99], []):
        assert looked_up(spark, index, asked, k, projects=projects) == everything(spark, [r for r in rows if r[2] in projects], asked, k)
    assert looked_up(spark, index, asked, k, most=10) == looked_up(spark, index, asked, k)


def test_kept_up_to_date_by_file(spark, asked, tmp_path):
    ensure_checkpoint_dir(spark)
    rows = passages(random.Random(5), 200)
    chunk_store, index = str(tmp_path / "s"), str(tmp_path / "i")
    frame = lambda r: spark.createDataFrame(r, SCHEMA)
    store.swap_chunks(spark, chunk_store, frame(rows), frame(rows), buckets=8)
    first = keyword_index.refresh(spark, chunk_store, index, lexes=4)
    assert keyword_index.refresh(spark, chunk_store, index).version == first.version
    gone, new = [r for r in rows if r[0] in (3, 4)], [(3, 10_000, 1, "word0 word1", "word2")]
    store.swap_chunks(spark, chunk_store, frame(new), frame(gone))
    rows = [r for r in rows if r[0] not in (3, 4)] + new
    second = keyword_index.refresh(spark, chunk_store, index)
    changed = [b for b, p in second.generation()["parts"].items() if first.generation()["parts"].get(b) != p]
    assert 1 <= len(changed) <= 2
    assert looked_up(spark, index, asked) == everything(spark, rows, asked)
    assert looked_up(spark, first, asked) != looked_up(spark, index, asked)  # who holds the older snapshot still reads it
    store.swap_chunks(spark, chunk_store, frame([]), frame(rows))
    keyword_index.refresh(spark, chunk_store, index)
    assert looked_up(spark, index, asked) == []


def test_stemmed(spark, asked, tmp_path):
    ensure_checkpoint_dir(spark)
    rows = [(1, 1, 0, "Connecting clients", "They connected."), (2, 2, 0, None, "A connection of the client")]
    store.swap_chunks(spark, str(tmp_path / "s"), spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows, SCHEMA))
    keyword_index.refresh(spark, str(tmp_path / "s"), str(tmp_path / "i"), lexed=stemmed)
    questions = spark.createDataFrame([(1, "connect clients")], "question long, text string")
    assert looked_up(spark, str(tmp_path / "i"), questions, lexed=stemmed) == everything(spark, rows, questions, lexed=stemmed)


def test_reads_the_folders_of_its_lexemes_alone(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    rng = random.Random(8)
    rows = [(i, i, 0, None, " ".join(f"term{rng.randrange(3_000)}" for _ in range(60))) for i in range(2_000)]
    chunks = spark.createDataFrame(rows, SCHEMA)
    store.swap_chunks(spark, str(tmp_path / "s"), chunks, chunks, buckets=2)
    snapshot = keyword_index.refresh(spark, str(tmp_path / "s"), str(tmp_path / "i"), lexes=32)
    of = lambda n: keyword_index.blocks(spark, snapshot, [r[0] for r in spark.createDataFrame([(f"term{k}",) for k in range(n)], "lexeme string").select(keyword_index.lex_of("lexeme", 32)).distinct().collect()])
    files = lambda df: {(r[0], r[1]) for r in df.select("_metadata.file_path", "_metadata.file_size").distinct().collect()}
    one, all_of_them = sum(s for _, s in files(of(1))), sum(s for _, s in files(of(3_000)))
    assert 0 < one < all_of_them / 16
    filters = next(x for x in of(1)._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x)
    assert "lex#" in filters.split("PartitionFilters")[1].split("]")[0]


def test_blocks_that_cannot_reach_the_best_stay_closed(monkeypatch):
    monkeypatch.setattr(keyword_index, "SUMMED", 1_000)
    rng = np.random.default_rng(1)

    def make(ids, weights, size=128):
        rows = [(len(c), int(c[0]), int(c[-1]), int(w.max()), keyword_index._packed(np.diff(c).astype(np.uint64)), keyword_index._packed(w)) for a in range(0, len(ids), size) for c, w in [(ids[a : a + size], weights[a : a + size])]]
        return keyword_index._List(rows)

    common = np.arange(100_000)
    rare = np.sort(rng.choice(100_000, 200, replace=False))
    lists = [make(common, rng.integers(1, 50, len(common))), make(rare, rng.integers(1, 50, len(rare)))]
    ids, values = keyword_index.best(lists, 10, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert len(ids) >= 10 and set(ids.tolist()) <= set(rare.tolist())
    assert len(lists[0].open) <= 200 < len(lists[0].data)
    weights = lists[0].look_up(rare) + lists[1].look_up(rare)
    assert sorted(values % keyword_index.ONE_MORE)[-10:] == sorted(weights)[-10:]
    alone = make(common, np.r_[np.full(50_000, 1), np.full(50_000, 9)])
    keyword_index.best([alone], 10, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert len(alone.open) <= 400 < len(alone.data)


@pytest.mark.parametrize("top", [0, 1, 255, 256, 65_535, 65_536, 2**32 - 1, 2**32, 2**63 - 1])
def test_numbers_come_back(top):
    numbers = np.array([0, top, 1], dtype=np.uint64)
    assert keyword_index._unpacked(keyword_index._packed(numbers)).tolist() == numbers.tolist()
