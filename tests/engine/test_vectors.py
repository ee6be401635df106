"""Nearest rows against a comparison of everything, and what a task holds and hands on."""

from __future__ import annotations

import resource
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from lodestar.functions import vectors


def direct(rows, questions, k):
    out = []
    for q, v in questions:
        sims = []
        for key, w in rows:
            n = 0 if w is None or v is None else np.linalg.norm(v) * np.linalg.norm(w)
            sims.append((-round(float(np.dot(v, w) / n), 9) if n > 0 else 2.0, key))
        out += [(q, key, None if s == 2.0 else -s) for s, key in sorted(sims)[:k]]
    return sorted(out, key=repr)


def best_of(frame, key, k):
    """The rows that candidates come down to."""
    by = {}
    for r in frame.collect():
        by.setdefault(r.question, []).append((2.0 if r.sim is None else -r.sim, r[key]))
    return sorted(((q, c, None if s == 2.0 else -s) for q, found in by.items() for s, c in sorted(found)[:k]), key=repr)


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_nearest(spark, monkeypatch, small, kind):
    rng = np.random.default_rng(3)
    rows = [(i * 7 % 501, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(500)]  # many ties
    rows += [(900, None), (901, [0.0] * 6), (902, rows[0][1]), (903, rows[0][1])]
    rows = [(f"k{a:04d}", v) if kind == "string" else (a, v) for a, v in rows]
    asked = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(40)] + [(50, [0.0] * 6)]
    if small:
        monkeypatch.setattr(vectors, "MATRIX_BYTES", 700)
        monkeypatch.setattr(vectors, "ROWS_A_TASK", 100)
        monkeypatch.setattr(vectors, "TILE_NUMBERS", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        frame = vectors.nearest(spark.createDataFrame(rows, f"chunk {kind}, counts array<double>"), "chunk", spark.createDataFrame(asked, "question long, counts array<double>"), 6, 7)
        assert best_of(frame, "chunk", 7) == direct(rows, asked, 7)
        one_task = vectors.nearest(spark.createDataFrame(rows, f"chunk {kind}, counts array<double>").coalesce(1), "chunk", spark.createDataFrame(asked, "question long, counts array<double>"), 6, 7)
        if not small:
            assert one_task.count() == 7 * len(asked)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fewer_rows_than_asked_for(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "chunk long, counts array<double>")
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, None)], "question long, counts array<double>")
    assert sorted(map(tuple, vectors.nearest(rows, "chunk", asked, 2, 5).collect())) == [(1, 1, 0.707106781), (1, 2, None), (2, 1, None), (2, 2, None)]
    assert vectors.nearest(rows.limit(0), "chunk", asked, 2, 5).collect() == vectors.nearest(rows, "chunk", asked.limit(0), 2, 5).collect() == []


def test_memory_of_many_questions():
    """65,536 questions meet batches of 10,000 rows in less than 500 MB."""
    code = """
import numpy as np, pyarrow as pa, resource
from lodestar.functions.vectors import Best
rng = np.random.default_rng(1)
lists = lambda n: pa.FixedSizeListArray.from_arrays(pa.array(rng.random(n * 64)), 64).cast(pa.list_(pa.float64()))
best = Best(pa.array(np.arange(65_536)), lists(65_536), "chunk", 64, 40)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for b in range(2):
    best.meet(pa.array(np.arange(2_000) + 10_000 * b), lists(2_000))
best.meet(pa.array(np.arange(10_000) + 50_000), lists(10_000))
assert sum(r.num_rows for r in best.found()) == 65_536 * 40
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert ran.returncode == 0, ran.stderr
    assert int(ran.stdout) < 500 + 100  # with the interpreter and its libraries
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss > 0


def test_counts_are_made_piece_by_piece(spark, monkeypatch):
    """A batch is cut before anything is made of it; rows keep their other columns, and texts of other types are read as strings."""
    monkeypatch.setattr(vectors, "TEXTS_AT_ONCE", 3)
    batch = pa.RecordBatch.from_pydict({"id": list(range(8)), "text": [None, "", *["some words here"] * 6]})
    assert [b.num_rows for b in vectors._count(4)(iter([batch]))] == [3, 3, 2]
    rows = spark.range(8).selectExpr("id", "IF(id = 5, NULL, concat('word', id, ' more')) AS text", "id * 1000 AS number")
    whole = {r.id: (r.text, r.number, r.a, r.b) for r in vectors.with_counts(rows, 8, a="text", b="number").collect()}
    for r in rows.collect():
        alone = [vectors._counter(8)(pa.array([v], pa.string())).to_pylist()[0] for v in (r.text, str(r.number))]
        assert whole[r.id] == (r.text, r.number, *alone)
