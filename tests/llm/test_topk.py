"""Top-k against all inner products."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import topk


def direct(rows, k=20, modulus=20):
    """Every row is a query of its own; scores out of a long's range are shown as the nearest long."""
    kept = [(i, [math.floor(64 * int(x)) if abs(x) > 2**53 else math.floor(64 * x) for x in map(float, map(np.float32, v))]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(kept):
        if i is None or i % modulus:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), math.inf if j is None else j) for m, (j, w) in enumerate(kept) if m != n and len(w) == len(v)]
        out += [(i, rank, None if j == math.inf else j, max(-(2**63), min(2**63 - 1, -score))) for rank, (score, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    return sorted((tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, **options).collect()), key=repr)


def test_ties_nulls_and_copies(spark):
    rng = random.Random(4)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(600)]
    rows += [(1000 + i, centres[0]) for i in range(150)]  # one common vector
    rows += [(40, rows[40][1])] * 2 + [(None, centres[1]), (2000, None), (2001, [1.0, None] + [0.0] * 6), (2020, [math.nan] + [0.0] * 7), (2040, [math.inf] + [0.0] * 7), (2060, []), (60, centres[2]), (2080, [1.0, 2.0]), (2100, [0.5, -1.0])]
    assert run(spark, rows) == direct(rows)


def test_fewer_than_k_and_empty(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)]
    assert run(spark, rows) == direct(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("leaf", [2, 16])
def test_many_blocks_and_parts(spark, monkeypatch, leaf):
    monkeypatch.setattr(topk, "ROWS_A_BLOCK", 20)
    monkeypatch.setattr(topk, "QUERIES_A_TASK", 5)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(500)]
    assert run(spark, rows, k=7) == direct(rows, k=7)


def test_pruning_leaves_out_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 60, (40, 16))
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 2, (4000, 16)))
    held = topk.make_candidates(np.arange(4000), np.ones(4000, dtype=np.int64), x, 5)
    q = x[::20]
    found = topk.search(held, np.arange(0, 4000, 20), q, 5)
    score = q @ x.T
    score[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    assert (np.sort(score, axis=1)[:, :-6:-1] == found.score).all()
    assert (np.sort(held.ids[found.which], axis=1) >= 0).all()


def test_large_components(spark, monkeypatch):
    """Beyond 2 ** 23 sums are no longer exact in doubles, beyond 2 ** 63 not even in longs; the order is exact all the same."""
    monkeypatch.setattr(topk, "ROWS_A_BLOCK", 40)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    rows += [(20_000, [200000.0, 1.0, 1.0, 1.0])]
    rows += [(300 + i, [float(np.float32(rng.choice([1, -1]) * 2.0 ** rng.randint(0, 40))) for _ in range(4)]) for i in range(150)]
    rows += [(600 + i, [float(np.float32(rng.choice([1, -1]) * rng.random() * 1e38)) for _ in range(4)]) for i in range(60)]
    rows += [(700 + i, [3e38, 3e38, float(i % 3), -1.0]) for i in range(50)]
    assert run(spark, rows) == direct(rows)


def test_empty_vectors_and_repeated_ids(spark):
    rows = [(20, []), (21, []), (40, []), (20, [1.0]), (20, [2.0]), (20, [2.0]), (None, [3.0]), (None, [3.0]), (5, [2.0])]
    assert run(spark, rows) == direct(rows)


def test_bound_handed_on_spares_rows(spark, monkeypatch):
    """Clustered vectors: most queries leave their own block for few others, and few rows come back."""
    monkeypatch.setattr(topk, "ROWS_A_BLOCK", 50)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (12, 8))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(0, 0.02, 8)]) for i in range(2_400)]
    routed, came_back = [], []
    monkeypatch.setattr(topk, "_route", lambda pivots, real=topk._route: routed.append(1) or real(pivots))
    monkeypatch.setattr(topk, "cut_lineage", lambda df, real=topk.cut_lineage: came_back.append(real(df)) or came_back[-1])
    assert run(spark, rows) == direct(rows)
    assert routed and came_back[-1].count() >= 20 * 100
    held = topk.make_candidates(np.arange(2_400), np.ones(2_400, dtype=np.int64), np.floor(64 * np.array([v for _, v in rows])), 20)
    q = held.x[::20]
    best = topk.search(held, np.arange(0, 2_400, 20), q, 20).score[:, -1]
    away = topk.search(topk.make_candidates(np.arange(9_000, 9_200), np.ones(200, dtype=np.int64), np.floor(64 * -np.array([v for _, v in rows[:200]])), 20), np.arange(0, 2_400, 20), q, 20, best)
    assert (away.which >= 0).sum() < 0.2 * 20 * len(q)


@pytest.mark.parametrize("seed", range(4))
def test_sort_keys_are_in_the_order_of_numbers(seed):
    rng = random.Random(seed)
    numbers = [rng.choice([1, -1]) * rng.getrandbits(rng.randint(0, 300)) for _ in range(300)]
    assert sorted(numbers) == sorted(numbers, key=topk.sort_key)


def test_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert run(spark, rows) == direct(rows)
