"""Tokens of each kind, and phrases, by literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestar.functions.tokens import positioned, tokens
from lodestar.operators.phrases import phrase_hits

CASES = {
    "See http://www.example.com/a/b?x=1, or example.org.": ["word see 1", "url www.example.com/a/b?x=1 2", "host www.example.com 3", "path /a/b?x=1 4", "word or 5", "host example.org 6"],
    "mail First.Last+x@mail.example.co.uk!": ["word mail 1", "email first.last+x@mail.example.co.uk 2"],
    "state-of-the-art, well-known": ["hyphenated state-of-the-art 1", "word state 2", "word of 3", "word the 4", "word art 5", "hyphenated well-known 6", "word well 7", "word known 8"],
    "version 1.20.3 costs 3.50 or 12": ["word version 1", "version 1.20.3 2", "word costs 3", "float 3.50 4", "word or 5", "int 12 6"],
    "getAccessToken für x1y": ["word get 1", "word access 2", "word token 3", "word für 4", "word x1y 5"],
    "": [],
}


def test_kinds(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "text string")
    for r in df.withColumn("t", tokens(F.col("text"))).collect():
        assert [f"{t.kind} {t.token} {t.pos}" for t in r.t] == CASES[r.text]
    assert [t.pos for t in df.limit(1).select(positioned(F.col("text")).alias("t")).first().t] == [1, 2, 3, 4, 6]  # "or" keeps its place
    assert spark.range(1).select(tokens(F.lit(None).cast("string")).alias("t")).first().t == []


PASSAGES = [(1, "Purchase order", "Approve the purchase order in the module. The purchase order is done."), (2, None, "An order to purchase, and orders of purchase"), (3, "Purchase", "order by mail to a@b.cd"), (4, None, "read the state-of-the-art paper at example.com/x now")]


@pytest.mark.parametrize(
    ("phrase", "found"),
    [
        ("purchase order", [(1, 1.2, 3), (3, round(2 / 11, 9), 1)]), ("order purchase", []), ("approve the purchase", [(1, 0.05, 1)]), ("approve purchase", []), ("the of", []), ("", []), (None, []),
        ("order by mail to a@b.cd", [(3, round(0.1 / 3, 9), 1)]), ("state-of-the-art paper", [(4, round(0.1 / 3, 9), 1)]), ("order to purchase", [(2, 0.05, 1)]), ("order", [(1, 1.2, 3), (2, 0.1, 1), (3, 0.1, 1)]),
    ],
)
def test_phrases(spark, phrase, found):
    hits = phrase_hits(spark.createDataFrame(PASSAGES, "chunk long, heading string, text string"), spark.createDataFrame([(7, phrase)], "question long, text string"))
    assert [(r.chunk, r.score, r.covers) for r in hits.orderBy("rank").collect()] == found


def test_phrases_by_views_and_by_places_are_the_same(spark, monkeypatch):
    from lodestar.operators import phrases as P

    words = "order purchase the of state-of-the-art a@b.cd module x1 paper example.com/x".split()
    passages = [(i, " ".join(words[(i * j) % 10] for j in range(1, 4)), " ".join(words[(i + j * j) % 10] for j in range(60))) for i in range(40)]
    asked = [(q, " ".join(words[(q + j * (q % 3 + 1)) % 10] for j in range(q % 6 + 1))) for q in range(60)] + [(99, " ".join(words[(j * j) % 10] for j in range(30)))]
    passages, asked = spark.createDataFrame(passages, "chunk long, heading string, text string"), spark.createDataFrame(asked, "question long, text string")
    found = {}
    for far in (P.AHEAD, 2, -1):
        monkeypatch.setattr(P, "AHEAD", far)
        found[far] = {tuple(r) for r in P.phrase_covers(passages, asked).collect()}
    assert found[P.AHEAD] == found[2] == found[16] and any(q == 99 for q, *_ in found[16])


def test_a_common_word_does_not_meet_every_phrase(spark):
    from lodestar.operators import phrases as P

    passages = spark.createDataFrame([(1, None, "order " * 500)], "chunk long, heading string, text string")
    asked = spark.createDataFrame([(q, f"order w{q} order") for q in range(50)], "question long, text string")
    covers = P.phrase_covers(passages, asked)
    assert covers.count() == 0 and "Aggregate" not in covers._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("seed", range(3))
def test_the_fast_pattern_finds_the_same_tokens(spark, seed):
    import random

    from lodestar.functions import tokens as K

    r = random.Random(seed)
    bits = ["ab", "é", "12", "x9", ".", ".", "-", "_", "@", "%", "+", "://", "http", "ftp", "/", "/p?q=1", " ", " ", "\n", ":", ",", "1.2", "com", "٣", "𝒳", "'", "<"]
    texts = spark.createDataFrame([("".join(r.choice(bits) for _ in range(r.randint(1, 14))),) for _ in range(8_000)], "text string")
    both = texts.select("text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(n) for n, p in (("slow", K.TOKEN), ("fast", K.FAST_TOKEN))])
    assert both.where("slow <> fast").limit(3).collect() == []
