"""SimHash against a direct computation over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import simhash
from lodestar.llm.components import label_components

DOCS = "doc_id long, text string, n_chars long, component_id string"


def direct_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def direct_components(ids, prints, threshold=3):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= threshold:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for i, x in enumerate(label):
        if ids[i] is not None:
            least[x] = min(least.get(x, ids[i]), ids[i])
    return [least.get(x) for x in label]


def check(spark, rows):
    df = spark.createDataFrame([(i, t, len(t or ""), "clash") for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    prints = [direct_print(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], prints, direct_components([i for i, _ in rows], prints), strict=True), key=repr)
    assert got == want


def test_documents_and_edge_cases(spark):
    rng = random.Random(3)
    words = [f"wort{i}É" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(25)]
    rows = list(enumerate(base)) + [(100 + i, base[i % 25] + " Extra WORDS") for i in range(40)]
    rows += [(None, base[3]), (None, "alone here with no id at all"), (200, None), (201, ""), (202, " \t\n"), (5, base[5]), (5, base[5]), (300, "a"), (301, "A b c"), (400, "x y z " * 30_000)]
    check(spark, rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_anchors_meet(spark):
    """Any two fingerprints within 3 bits share an anchor; each half has 1 or 16 anchors, all of the code."""
    rng = random.Random(5)
    pairs = []
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        pairs.append((np.int64(np.uint64(a)).item(), np.int64(np.uint64(b)).item()))
    df = spark.createDataFrame(pairs, "a long, b long").select(simhash.anchors(F.col("a")).alias("x"), simhash.anchors(F.col("b")).alias("y"))
    for row in df.collect():
        assert set(row.x) & set(row.y)
        for key in row.x:
            assert all(bin(key & m).count("1") % 2 == 0 for m in simhash.CHECKS)


def test_crowded_anchors_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_AT_ANCHOR", 16)
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    prints = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(64) if rng.random() < 0.2 else 0) for _ in range(150)}
    prints = sorted(np.array(sorted(prints), dtype=np.uint64).view(np.int64).tolist())
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    got = {r.node: r.component for r in label_components(links).collect()}
    want = direct_components(list(range(len(prints))), [p % 2**64 for p in prints])
    assert [got.get(p, p) for p in prints] == [prints[i] for i in want]


def test_long_chain_of_components(spark):
    n = 70
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(200, 100), (100, 200), (300, 300)], "a long, b long")
    assert {(r.node, r.component) for r in label_components(edges).collect()} == {(i, 0) for i in range(n)} | {(100, 100), (200, 100)}


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_compare_carries_groups_over_batches(size):
    fp = np.arange(size, dtype=np.int64) * 0
    fp = np.array([1 << i for i in range(size)], dtype=np.int64)
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(size, dtype=np.int64)), pa.array(np.zeros(size, dtype=np.int32)), pa.array(np.sort(fp))], names=["key", "part", "fp"])
    cut = [rows.slice(i, 1) for i in range(size)]
    edges = [r for b in simhash._compare(iter(cut)) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert len(edges) == size - 1
