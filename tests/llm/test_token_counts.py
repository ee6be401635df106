"""Token counts against trying every cut of every pre-token."""

from __future__ import annotations

import re

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import token_counts as C

PATH = public_tokenizers.path("piece_bpe_32k.model")


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=4), st.sampled_from([-1.0, -2.0, -2.5, -4.0]), min_size=1, max_size=12), st.lists(st.text("abcé", min_size=1, max_size=10), max_size=20))
def test_small_vocabularies(scores, tokens):
    known = C.Vocabulary(scores)
    got = known.count_all(set(tokens))
    assert got == {t: C.best_cut(t, scores, known.byte) for t in set(tokens)}
    assert all(known.count_one(t) == n for t, n in got.items())


def test_prefixes_are_scored_once(monkeypatch):
    known = C.Vocabulary({"a": -1.0, "b": -1.0})
    steps = []
    step = C.Vocabulary.step
    monkeypatch.setattr(C.Vocabulary, "step", lambda self, c, *rest: steps.append(c) or step(self, c, *rest))
    known.count_all(["aaab", "aaaa", "aab", "aaa"])
    assert len(steps) == 6


def test_documents_and_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_STORED", 500)
    monkeypatch.setattr(C, "WORDS_AT_ONCE", 300)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    rows = [(r.doc_id, r.text, "x") for r in docs.collect()] + [(1, None, "x"), (None, "", "x"), (2, "w" * 3_000 + " end\x1cx y 😀", None), (2, "w w", None), (2, "w w", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    scores = C.zipf_scores(PATH)
    byte = C.Vocabulary(scores).byte
    seen = {}

    def direct(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return len(words), sum(seen.setdefault(w, C.best_cut(C.MARK + w, scores, byte)) if w not in seen else seen[w] for w in words)

    got = C.count_tokens(df, path=PATH).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.n_words, r.n_tokens) for r in got) == sorted((i or 0, t or "", *direct(t)) for i, t, _ in rows)
    assert C.count_tokens(df.limit(0), path=PATH).collect() == []
