"""Mixing against a queue simulated in Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestar.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string"


def direct(rows):
    docs = []
    for i, t, s, *_ in rows:
        key = int(hashlib.md5(f"17:{'null' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
        docs.append((s, key, i, len((t or "").split())))
    total = defaultdict(int)
    for s, *_, n in docs:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(total.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if 2 * total[s] <= level * weight[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            free.discard(s)
    copies, cum = [], defaultdict(int)
    for d in sorted(docs, key=lambda d: (d[1], d[2] is not None, d[2] or 0, d[3])):
        cum[d[0]] += d[3]
        for epoch in range(2):
            if d[3] and target[d[0]]:
                copies.append(((cum[d[0]] + epoch * total[d[0]]) / target[d[0]], d[1], d[0] is not None, d[0] or "", epoch, d))
    taken, run = Counter(), 0
    for c in sorted(copies, key=lambda c: c[:5]):
        run += c[5][3]
        if run > 1.5 * sum(total.values()):
            break
        taken[c[5]] += c[5][3]
    return total, target, taken


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(df, keep=["doc_id", "source"]).collect()
    total, target, taken = direct(rows)
    assert len(got) == len(rows)
    by_row = Counter()
    for r in got:
        assert r.source_size == total[r.source]
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        by_row[r.source, r.doc_id, r.size] += r.taken
    want = Counter()
    for (s, _, i, n), t in taken.items():
        want[s, i, n] += t
    assert +by_row == +want


def test_sources_ties_and_nulls(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["hot"] * 6 + ["b", "c", "Z", "é", None]), "clash", "clash") for i in range(400)]
    rows += [(None, "a b c", "b", None, None)] * 3 + [(7, None, "c", None, None), (9, "x " * 5_000, "long", None, None), (8, "", "empty", None, None)]
    check(spark, rows)


def test_several_rounds_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGES", 4)
    monkeypatch.setattr(mixing, "ROWS_A_RANGE", 5)
    rng = random.Random(6)
    check(spark, [(i, "w " * rng.randint(0, 9), rng.choice("abcde"), "x", "y") for i in range(200)])


def test_all_empty_and_no_rows(spark):
    assert {(r.taken, r.target) for r in mixing.mix_sources(spark.createDataFrame([(1, "", "a", "", ""), (2, None, None, "", "")], SCHEMA)).collect()} == {(0, 0.0)}
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_of_one_id_do_not_share_a_bucket(spark):
    """A third of all rows without an id, in one source: their places in the queue are all over it."""
    rows = [(None if i % 3 else i, f"text number {i} of the source", "s") for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keys = df.select(mixing.shuffle_key(F.col("doc_id"), F.col("text"), 17).alias("k")).selectExpr("shiftright(k, 52) AS b").groupBy("b").count()
    assert keys.count() > 250 and keys.agg(F.max("count")).first()[0] < 40
    assert Counter(map(tuple, mixing.mix_sources(df, keep=["doc_id"]).collect())) == Counter(map(tuple, mixing.mix_sources(df.repartition(7), keep=["doc_id"]).collect()))
