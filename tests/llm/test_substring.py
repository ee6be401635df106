"""Substring dedup against a direct computation over all windows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from lodestar.llm import substring, windows


def direct(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    rank = [substring.NO_ID if i is None else i for i, _ in rows]
    least = {}
    for r, w in zip(rank, words, strict=True):
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            least[key] = min(least.get(key, r), r)
    out = []
    for (i, _), r, w in zip(rows, rank, words, strict=True):
        gone = set()
        for s in range(len(w) - width + 1):
            if least[tuple(w[s : s + width])] < r:
                gone.update(range(s, s + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def fixture(rng, n=40):
    vocabulary = [f"w{i}é" for i in range(200)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(45, 150))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 90))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(100, rows[3][1]), (None, rows[3][1]), (None, rows[3][1]), (101, None), (102, ""), (7, rows[7][1]), (7, rows[5][1]), (103, " ".join(["same"] * 300)), (104, " ".join(["same"] * 120))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_documents_and_edge_cases(spark, seed, monkeypatch):
    if seed == 2:  # a part of a text, a full sketch and full bit maps change nothing
        monkeypatch.setattr(windows, "WORDS_AT_ONCE", 64)
        monkeypatch.setattr(substring, "LEAST_COUNTERS", 1 << 16)
        monkeypatch.setattr(substring, "MOST_COUNTERS", 1 << 16)
    rows = fixture(random.Random(seed))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rid int")
    got = sorted((tuple(r) for r in substring.dedup_substrings(df).collect()), key=repr)
    assert got == direct(rows, 50)


@pytest.mark.parametrize("bits", [3, 7])
def test_weak_hashes_decide_nothing(spark, bits):
    """With words of 3 or 7 bits nearly all representatives and contexts collide; the words' own keys decide."""
    rows = fixture(random.Random(5))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in substring.dedup_substrings(df, word_bits=bits).collect()), key=repr)
    assert got == direct(rows, 50)


def test_blocks_sent_to_their_slices(spark, monkeypatch):
    monkeypatch.setattr(substring, "MOST_BROADCAST", 0)
    rows = fixture(random.Random(6))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in substring.dedup_substrings(df).collect()), key=repr)
    assert got == direct(rows, 50)


def test_both_ways_find_the_same_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("text", "doc_id AS rid")
    sketch = substring.repeated_counters(docs.select("text"), 50, 1 << 17).cache()
    held = spark.sparkContext.broadcast(substring._gathered(sketch, 1 << 17))
    near = docs.mapInArrow(substring._candidates(50, 64, held), substring._BLOCK)
    far = substring._by_slice(docs.mapInArrow(substring._candidates(50, 64), substring._BLOCK), sketch, 1 << 17)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect())) and near.count() > 0


def test_one_row_many_times(spark):
    rng = random.Random(8)
    text = " ".join(rng.choice("abcdefgh") * 3 for _ in range(70))
    rows = [(5, text)] * 20_000 + [(None, text)] * 20_000 + [(1, "x " * 60 + text)]
    got = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(1, 130, 0, 1), (5, 70, 70, 20_000), (None, 70, 70, 20_000)], key=repr)


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in substring.dedup_substrings(docs).collect()), key=repr)
    assert got == direct(rows, 50)


def test_empty_table(spark):
    assert substring.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_window_is_in_one_block_and_equal_windows_agree():
    rng = random.Random(9)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.choice([0, 10, 50, 51, 200, 700]))] for _ in range(30)]
    old, windows.WORDS_AT_ONCE = windows.WORDS_AT_ONCE, 256
    try:
        found = {}
        for b in windows.blocks_of(texts, 12):
            for k in range(len(b.text)):
                for j in range(b.count[k]):
                    place = (int(b.text[k]), int(b.start[k]) + j)
                    assert place not in found
                    at = int(b.place[b.first[k] + j])
                    assert b.words[at : at + 12] == texts[place[0]][place[1] : place[1] + 12]
                    found[place] = (int(b.gram[k]), *b.window_keys(np.array([k]), 12)[1][j].tolist())
    finally:
        windows.WORDS_AT_ONCE = old
    assert set(found) == {(i, s) for i, t in enumerate(texts) for s in range(len(t) - 11)}
    by_words = {}
    for (i, s), value in found.items():
        assert by_words.setdefault(tuple(texts[i][s : s + 12]), value) == value
    assert len(set(by_words.values())) == len(by_words)
