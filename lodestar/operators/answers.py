"""Answers against their sources, over tables: (…, answer, question, sources: array of texts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.constants import MIN_BEST, MIN_SUPPORTED, MIN_WORDS, NOT_FOUND
from lodestar.functions.answer_text import cited, grounded, is_hedged, markers, sentences, tidied, unmarked
from lodestar.functions.arrays import let
from lodestar.functions.code_blocks import guarded, verbatim
from lodestar.functions.text import is_not_found, terms, topic_terms

__all__ = ["best_source", "checked", "graded", "markers", "off_topic", "support", "verbatim"]


def best_source(words: Column, source_terms: Column) -> Column:
    """(score, n): the largest share of the words that a source has, and the first source that has it."""
    scored = F.transform(source_terms, lambda s, i: F.struct((F.size(F.array_intersect(words, s)) / F.size(words)).alias("score"), (-i).alias("order"), (i + 1).alias("n")))
    return F.array_max(scored)


def graded(answer: Column, sources: Column, known: Column | None = None) -> Column:
    """Each prose sentence of three content words or more: (sentence, words, best). ``known``: the sources' terms, if at hand."""

    def over(known: Column) -> Column:
        rows = F.transform(sentences(answer), lambda s: F.struct(s.alias("sentence"), terms(unmarked(s)).alias("words")))
        rows = F.filter(rows, lambda r: F.size(r["words"]) >= MIN_WORDS)
        return F.transform(rows, lambda r: F.struct(r["sentence"].alias("sentence"), F.size(r["words"]).alias("n_words"), best_source(r["words"], known).alias("best")))

    return let(F.transform(sources, terms), over) if known is None else over(known)


def support(answers: DataFrame, known: Column | None = None) -> DataFrame:
    """Adds supported (share of content words in backed sentences, 1 if there are none) and hedged."""
    rows = answers.withColumn("graded", graded(F.col("answer"), F.col("sources"), known))
    total = F.aggregate("graded", F.lit(0), lambda s, g: s + g["n_words"])
    backed = F.aggregate("graded", F.lit(0), lambda s, g: s + F.when(F.coalesce(g["best"]["score"], F.lit(0.0)) >= MIN_BEST, g["n_words"]).otherwise(0))
    return rows.withColumn("supported", F.when(total > 0, backed / total).otherwise(1.0)).withColumn("hedged", is_hedged(F.col("answer"))).drop("graded")


def off_topic(question: Column, answer: Column, sources: Column, known: Column | None = None) -> Column:
    """Topic words of the question that no source has and the answer uses."""
    all_known = F.flatten(F.transform(sources, terms) if known is None else known)
    return F.array_sort(F.array_intersect(F.array_except(topic_terms(question), all_known), terms(F.array_join(sentences(answer), " "))))


def checked(answers: DataFrame, keep: list[str]) -> DataFrame:
    """Every answer guarded against invented code, its markers tidied, and then replaced or grounded.

    Replaced by the not-found sentence is what hedges, leaves the question's topic or is less than half supported. Sources
    are the texts in rank order; a column ``after`` (map of places, from 1) says which source goes on with which.
    Null texts are empty. Without sources an answer stays as it is, but for its markers.
    """
    sources = F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda s: F.coalesce(s, F.lit("")))
    after = F.col("after") if "after" in answers.columns else F.lit(None)
    rows = answers.select(F.struct(*keep).alias("row"), F.coalesce("answer", F.lit("")).alias("given"), F.coalesce("question", F.lit("")).alias("question"), sources.alias("sources"), after.cast("map<int,int>").alias("after"))
    rows = rows.withColumn("guarded", guarded(F.col("given"), F.col("sources"), F.col("question"), F.col("after")))
    rows = rows.withColumn("raw", F.col("guarded.text")).withColumn("n", F.size("sources")).withColumn("answer", tidied(F.col("raw"), F.col("n")))
    rows = rows.withColumn("bare", (F.col("n") == 0) | is_not_found(F.col("answer"))).withColumn("known", F.transform("sources", terms))
    known = F.col("known")  # made once a row: support, topic and grounding all compare with it
    rows = support(rows, known)
    strays = (F.col("question") != "") & (F.size(off_topic(F.col("question"), F.col("answer"), F.col("sources"), known)) > 0)
    rows = rows.withColumn("replaced", ~F.col("bare") & (F.col("hedged") | (F.col("supported") < MIN_SUPPORTED) | strays))
    own = grounded(F.col("answer"), known)
    rows = rows.withColumn("final", F.when(~F.col("bare") & ~F.col("replaced"), own).otherwise(F.struct(F.when(F.col("replaced"), NOT_FOUND).otherwise(F.col("answer")).alias("text"), F.lit(0).alias("changes"))))
    return rows.select(
        *[F.col("row").getField(c).alias(c) for c in keep],
        F.col("final.text").alias("text"),
        cited(F.col("final.text")).alias("cited"),
        F.filter(markers(F.col("raw")), lambda x: ~x.between(1, F.col("n"))).alias("invalid"),
        (F.col("replaced") | is_not_found(F.col("answer"))).alias("not_found"),
        F.col("final.changes").alias("regrounded"),
        F.when(F.col("bare"), 1.0).otherwise(F.col("supported")).alias("supported"),
        F.col("guarded.changes").alias("code_changes"),
    )
