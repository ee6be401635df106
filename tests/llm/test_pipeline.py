"""The pipeline's stages on a small table: each one's decisions take effect on what the one before it kept."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm.near_copies import keep_one_each
from lodestar.llm.quality import judge_quality
from tests.llm.test_near_copies import direct_survivors, edited

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string, size int, row int, redacted string"


def rows_of(n=60):
    rng = random.Random(8)
    words = [f"wort{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = ". ".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(rng.randint(5, 60)))
        if i % 7 == 0:
            text += ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and more.'
        rows.append((i, text, "de", f"s{i % 4}"))
    rows += [(100 + i, rows[i][1], "de", "s1") for i in range(8)]  # copies
    rows += [(300 + i, edited(rng, rows[i][1], 1 + len(rows[i][1].split()) // 80), "de", "s2") for i in range(20)]  # edited ones
    rows += [(200, "### $$$ %%% &&& " * 40, "xx", "s1"), (201, "too short", "xx", "s2"), (202, "", "xx", "s2"), (203, None, None, None), (None, rows[5][1], "de", "s3"), (None, "another text of its own " + rows[6][1][::-1], "de", None), (7, rows[7][1], "de", "s3"), (7, rows[7][1], "de", "s3")]
    return [(*r, len(r[1] or ""), "a", "b", 1, 2, "c") for r in rows]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.createDataFrame(rows_of(), SCHEMA)
    outputs = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, "unused")
        docs.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        outputs.append(docs)
    return outputs


def test_quality(stages):
    kept = Counter((r.doc_id, r.text) for r in stages[1].collect())
    wanted = Counter((r.doc_id, r.text) for r in judge_quality(stages[0].select(*corpus_pipeline.COLUMNS)).filter("kept").collect())
    assert kept == wanted and stages[1].columns == corpus_pipeline.COLUMNS
    assert not {200, 201, 202, 203} & {i for i, _ in kept}
    assert set(range(60)) <= {i for i, _ in kept}


def test_one_of_each_group(stages):
    """Held against the exact similarity of all pairs: copies and edited ones go, and nothing else does."""
    before, after = [(r.doc_id, r.text) for r in stages[1].collect()], [(r.doc_id, r.text) for r in stages[2].collect()]
    wanted = direct_survivors(before)
    assert sorted(2**63 if i is None else i for i, _ in after) == wanted
    assert set(after) <= set(before) and len(wanted) < len({t for _, t in before}) - 10


def test_secrets_are_masked(stages):
    before, after = {r.doc_id: r for r in stages[2].collect()}, {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r.text == before[i].text.replace("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "<SECRET>")
        assert r.n_chars == len(r.text)


def test_mix_is_near_its_targets(stages):
    before, after = stages[3].collect(), stages[4].collect()
    size = {r.doc_id: len(r.text.split()) for r in before}
    source = defaultdict(int)
    for r in before:
        source[r.source] += size[r.doc_id]
    names = sorted(source, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(source.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if 2 * source[s] < level * weight[s]]
        for s in over:
            target[s] = 2 * source[s]
            left -= target[s]
            free.discard(s)
        if not over:
            break
    target |= {s: level * weight[s] for s in free}
    taken = Counter(r.doc_id for r in after)
    assert max(taken.values()) <= 2
    for s in names:
        got = sum(size[r.doc_id] for r in after if r.source == s)
        assert abs(got - target[s]) <= max(size.values()), s


def test_packing(stages):
    pieces = stages[5].collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(r.doc_id for r in stages[4].collect())
    bins = defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 2048


def test_run_is_the_stages(spark, tmp_path):
    spark.createDataFrame(rows_of(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    one, two = corpus_pipeline.run(spark, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, two.collect()))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "unused").collect() == []


def test_rows_of_equal_id_and_text(spark):
    docs = spark.createDataFrame([(1, "a b c d")] * 3 + [(None, "x y z w")] * 2 + [(1, "quite another text here")], "doc_id long, text string")
    assert sorted(tuple(r) for r in keep_one_each(docs.select("doc_id", "text"), ["text"]).select(F.col("text")).collect()) == [("a b c d",), ("quite another text here",), ("x y z w",)]
