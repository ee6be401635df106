"""Source divergence against a direct computation."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.llm import divergence
from lodestar.llm.divergence import share, source_divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def direct(rows, min_docs=3, most=200):
    rows = [(t or "", g or "", s or "") for t, g, s in rows]
    out = []
    for lang in {g for _, g, _ in rows}:
        docs, counts = Counter(), {s: Counter() for _, g, s in rows if g == lang}
        for text, g, source in rows:
            if g == lang:
                words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
                docs.update(set(words))
                counts[source].update(words)
        kept = [t for t, n in docs.items() if n >= min_docs]
        whole = Counter()
        for c in counts.values():
            whole.update(c)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out += [(lang, s, part, item, -v, r + 1) for r, (v, _, item) in enumerate(found)]
    return sorted(out)


def fixture(seed):
    rng = random.Random(seed)
    words = ["The", "the", "THE", "été", "Été", "ÉTÉ", "日本", "x1y", "a-b", "don't", "naïve", "\U0001f600", "z"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for _ in range(120):
        source = rng.choice(["s1", "s2", "s3", "Ω", None])
        some = words if source == "s1" else words[: rng.randint(5, len(words))]
        rows.append((" ".join(rng.choice(some) for _ in range(rng.choice([0, 1, 5, 60]))), rng.choice(["en", "en", "fr", None, ""]), source))
    rows += [(None, "en", "only null"), ("", "xx", "a"), ("123 456", "xx", "b"), ("once", "yy", "a"), ("w1 " * 50_000, "en", "s1"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("near", [True, False])
def test_documents_and_edge_cases(spark, seed, near, monkeypatch):
    if not near:
        monkeypatch.setattr(divergence, "MOST_BROADCAST", -1)
    rows = fixture(seed)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in source_divergence(df).collect()) == direct(rows)


def test_parameters(spark):
    rows = fixture(3)
    df = spark.createDataFrame([(7, s, g, t, "x") for t, g, s in rows], "doc_id int, origin string, language string, body string, value string")
    got = source_divergence(df, text_col="body", lang_col="language", source_col="origin", min_docs=1, most_terms=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == direct(rows, 1, 4)


def test_many_sources(spark):
    rng = random.Random(5)
    rows = [(" ".join(f"t{chr(97 + rng.randrange(26))}" for _ in range(8)), "en", f"source {k % 150}") for k in range(600)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in source_divergence(df).collect()) == direct(rows)


def test_shares_are_exact_for_large_counts(spark):
    rng = random.Random(4)
    rows = [(0, 0, 1), (9 * 10**9 - 2, 9 * 10**9, 7), (9 * 10**9 - 1, 9 * 10**9, 7), (9 * 10**15 - 8, 9 * 10**15 - 8, 8)]
    for _ in range(500):
        total = rng.randrange(10 ** rng.randint(1, 15))
        rows.append((rng.randint(0, total), total, rng.randint(1, 10**6)))
    df = spark.createDataFrame(rows, "c long, total long, v long")
    for r in df.withColumn("share", share(F.col("c"), F.col("total"), F.col("v"))).collect():
        assert r["share"] == 1 + 10**9 * (r["c"] + 1) // (r["total"] + r["v"])


def test_empty_table(spark):
    assert source_divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
