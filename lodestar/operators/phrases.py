"""Phrases: passages in which a question's tokens stand next to each other, in order.

A phrase's tokens have places in it. A passage's place meets the phrases that begin with its token and go on with the one that stands as far
behind it as their second does; the rest is compared where they meet, with the ``AHEAD`` places behind. So what is made by a common word is not paired with every
phrase that has it. Of a phrase that is longer than that, every token says where the phrase would begin; where all of them say the same beginning, it is there.

Each such cover counts with the harmonic mean of its places' weights (a heading's 1, a text's 0.1), divided by one more than the places in it
that are none of the phrase's tokens (stop words).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.constants import CANDIDATES
from lodestar.functions.text import ENGLISH_STOP
from lodestar.functions.tokens import positioned, tokens
from lodestar.operators.search import BROADCAST_TERMS, ranked

AHEAD = 16


def token_places(passages: DataFrame) -> DataFrame:
    """(chunk, token, pos, w): every place of a token; the text goes on counting after the heading. Weights are tenths."""
    rows = passages.select("chunk", positioned(F.col("heading")).alias("h"), F.size(tokens(F.col("heading"))).alias("n"), positioned(F.col("text")).alias("t"))
    place = lambda t, after, w: F.struct(t["token"].alias("token"), (t["pos"] + after).alias("pos"), F.lit(w).alias("w"))
    both = F.concat(F.transform("h", lambda t: place(t, F.lit(0), 10)), F.transform("t", lambda t: place(t, F.col("n"), 1)))
    return rows.select("chunk", F.explode(both).alias("p")).select("chunk", "p.*")


def views_ahead(passages: DataFrame, far: int) -> DataFrame:
    """(chunk, start, headed, ahead): for every place of a token, this one and the ``far`` next; stop words are null. ``headed``: places of the heading from here on."""
    seen = lambda c: F.transform(tokens(F.col(c)), lambda t: F.when(~((t["kind"] == "word") & t["token"].isin(*ENGLISH_STOP)), t["token"]))
    rows = passages.select("chunk", seen("heading").alias("h"), seen("text").alias("t"))
    rows = rows.select("chunk", F.size("h").alias("n"), F.concat("h", "t").alias("line")).where(F.size("line") > 0)
    view = lambda i: F.struct(i.alias("start"), F.slice("line", i, F.lit(far + 1)).alias("ahead"))
    each = rows.select("chunk", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("line")), view)).alias("v"))
    return each.select("chunk", "v.start", (F.col("n") - F.col("v.start") + 1).alias("headed"), "v.ahead").where("ahead[0] IS NOT NULL")


def phrase_covers(passages: DataFrame, phrases: DataFrame) -> DataFrame:
    """(question, chunk, start, value) for every place where a phrase (question, text) is; phrases of stop words alone are nowhere."""
    asked = phrases.select("question", positioned(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    first, last = F.element_at("terms", 1)["pos"], F.element_at("terms", -1)["pos"]
    asked = asked.select("question", F.size("terms").alias("n"), (last - first + 1 - F.size("terms")).alias("gaps"), (last - first).alias("span"), F.transform("terms", lambda t: F.struct(t["token"].alias("token"), (t["pos"] - first).alias("off"))).alias("terms"))
    asked = asked.withColumn("gap", F.coalesce(F.get("terms", F.lit(1))["off"], F.lit(0)))
    sizes = asked.agg(F.sum("n").alias("n"), F.max("span").alias("longest"), F.max(F.when(F.col("span") <= AHEAD, F.col("span"))).alias("span"), F.collect_set(F.when(F.col("span") <= AHEAD, F.col("gap"))).alias("gaps")).first()
    near = F.broadcast if (sizes["n"] or 0) <= BROADCAST_TERMS else lambda df: df
    value = F.col("n") / F.col("inverse") / (1 + F.col("gaps"))

    def of_short() -> DataFrame:
        keys = F.array(*[F.struct(F.lit(g).alias("gap"), F.get("ahead", F.lit(g)).alias("second")) for g in sorted(sizes["gaps"])])
        places = views_ahead(passages, sizes["span"]).select("*", F.explode(keys).alias("k")).select("chunk", "start", "headed", "ahead", F.get("ahead", F.lit(0)).alias("first"), "k.*").where("second IS NOT NULL")
        short = asked.where(F.col("span") <= AHEAD).withColumn("first", F.get("terms", F.lit(0))["token"]).withColumn("second", F.coalesce(F.get("terms", F.lit(1))["token"], F.col("first")))
        met = places.join(near(short), ["first", "second", "gap"]).where(F.forall("terms", lambda t: F.get("ahead", t["off"]) == t["token"]))
        inverse = F.aggregate("terms", F.lit(0.0), lambda s, t: s + F.when(t["off"] < F.col("headed"), 1.0).otherwise(10.0))
        return met.withColumn("inverse", inverse).select("question", "chunk", "start", value.alias("value"))

    def of_long() -> DataFrame:
        terms = asked.where(F.col("span") > AHEAD).select("question", "n", "gaps", F.explode("terms").alias("t")).select("question", "n", "gaps", "t.*")
        met = token_places(passages).join(near(terms), "token").withColumn("start", F.col("pos") - F.col("off"))
        covers = met.groupBy("question", "chunk", "start").agg(F.count("*").alias("there"), F.max("n").alias("n"), F.max("gaps").alias("gaps"), F.sum(F.lit(10.0) / F.col("w")).alias("inverse"))
        return covers.where("there = n").select("question", "chunk", "start", value.alias("value"))

    if sizes["longest"] is None or sizes["longest"] <= AHEAD:
        return of_short() if sizes["gaps"] else of_long()
    return of_short().unionByName(of_long()) if sizes["gaps"] else of_long()


def phrase_hits(passages: DataFrame, phrases: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(question, chunk, score, covers, rank): passages that have the phrase, by the sum over its covers."""
    found = phrase_covers(passages, phrases).groupBy("question", "chunk").agg(F.round(F.sum("value"), 9).alias("score"), F.count("*").alias("covers"))
    return ranked(found, k, F.col("score").desc())
