"""Quality rules: the statistics against a direct count, EM against a loop, and judgements on the labelled documents."""

from __future__ import annotations

import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import quality


def direct(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_statistics_and_edge_cases(spark):
    texts = ["", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x x", "a b c d\n\na b c d\n a b c d\r\n", "é 😀 # $ | a\x0bb\x0cc\x1cd", "to be or not to be or not to " * 4_000, None]
    rows = [(i, t, "clash", True) for i, t in enumerate(texts)] + [(None, "a b c", "x", None), (1, "a b", "x", None), (1, "a b", "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept boolean")
    got = quality.judge_quality(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == direct(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.judge_quality(df.limit(0)).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = quality.judge_quality(docs).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == direct(r.text)
    judged = [(labels[r.doc_id], r.kept) for r in got if r.doc_id in labels and not r.base_failed]
    assert all(kept for good, kept in judged if good) and not any(kept for good, kept in judged if not good)


@settings(max_examples=20, deadline=None)
@given(st.dictionaries(st.tuples(*[st.integers(0, 2)] * 3), st.integers(1, 50), min_size=1, max_size=8))
def test_em_is_the_loop(spark, patterns):
    accuracy = [quality.START] * 3
    rows = sorted(patterns.items())
    for _ in range(5):
        good = [1 / (1 + math.exp(-sum((v[j] - 1) * math.log(a / (1 - a)) for j, a in enumerate(accuracy)))) for v, _ in rows]
        hits = [sum(n * (g if v[j] == 2 else 1 - g if v[j] == 0 else 0) for (v, n), g in zip(rows, good, strict=True)) for j in range(3)]
        cast = [sum(n for v, n in rows if v[j] != 1) for j in range(3)]
        accuracy = [(h + quality.START * quality.PSEUDO) / (c + quality.PSEUDO) for h, c in zip(hits, cast, strict=True)]
    df = spark.createDataFrame([(list(v), n) for v, n in rows], "v array<int>, n long")
    got = quality.estimate(df, 3, rounds=5)
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, accuracy, strict=True))
