"""Hybrid retrieval for batches of questions: ranked lists, fusion, relevance, packing.

Questions have (question, text, counts), passages (chunk, project, heading, text, counts, heading_counts); counts are
vectors. Every list is (question, chunk, score, rank). Ranking works on ids and vectors alone, texts are joined after the
cut. The questions' vectors are matrices in memory (see ``vectors.nearest``), and every batch of passages is one product.

Passages are restricted to projects below every list (``of_projects``): what a user may not see is neither ranked nor
counted. An empty list of projects has no passages.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.constants import (
    ANSWER_RESERVE_TOKENS,
    CANDIDATES,
    KEYWORD_COVERAGE,
    KEYWORD_WEIGHT,
    OVERVIEW_CANDIDATES,
    OVERVIEW_WEIGHT,
    PROMPT_SLACK,
    RELATED_SIMILARITY,
    RRF_K,
    SECTION_CANDIDATES,
    SECTION_DISTINCT_MARGIN,
    SECTION_TIE_MARGIN,
    SECTION_WEIGHT,
    SIMILARITY_SLACK,
    SOURCE_OVERHEAD,
    TOP_K,
    VECTOR_WEIGHT,
)
from lodestar.functions.text import estimated_tokens, is_definitional, is_overview, lexemes
from lodestar.functions.vectors import dot, nearest, norm
from lodestar.lineage import written

BROADCAST_TERMS = 200_000
#: Characters of passages whose postings one task adds up.
TEXT_A_TASK = 8_000_000
DIGITS = 9


def of_projects(passages: DataFrame, projects: Sequence[int] | None) -> DataFrame:
    """The passages of these projects; of all for None, and none at all for an empty list."""
    return passages if projects is None else passages.where(F.col("project").isin(*projects) if projects else F.lit(False))


def ranked(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k best of each question; ties by chunk."""
    place = Window.partitionBy("question").orderBy(*order, "chunk")
    return scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def vector_hits(passages: DataFrame, questions: DataFrame, dim: int, k: int = CANDIDATES, within: Column | None = None) -> DataFrame:
    slim = (passages if within is None else passages.where(within)).select("chunk", "counts")
    scored = nearest(slim, "chunk", questions, dim, k).select("question", "chunk", F.col("sim").alias("score"))
    return ranked(scored, k, F.col("score").desc_nulls_last())


def places(passages: DataFrame, lexed=lexemes) -> DataFrame:
    """(chunk, lexeme, w): every place of a lexeme, a heading's weighs 10 and a text's 1."""
    both = F.concat(F.transform(lexed(F.coalesce("heading", F.lit(""))), lambda w: F.struct(w.alias("lexeme"), F.lit(10).alias("w"))), F.transform(lexed(F.coalesce("text", F.lit(""))), lambda w: F.struct(w.alias("lexeme"), F.lit(1).alias("w"))))
    return passages.select("chunk", F.explode(both).alias("p")).select("chunk", "p.lexeme", "p.w")


def postings(passages: DataFrame, lexed=lexemes) -> DataFrame:
    """(chunk, lexeme, weight): a lexeme's summed weight in a passage: 1 for a place in its heading, 0.1 in its text.

    Passages are dealt by chunk into tasks of about ``TEXT_A_TASK`` characters, and each adds up its own: what a task holds does not grow with the table.
    """
    size = passages.agg(F.sum(F.coalesce(F.length("heading"), F.lit(0)) + F.coalesce(F.length("text"), F.lit(0)))).first()[0] or 0
    tasks = max(int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TEXT_A_TASK))
    dealt = passages.select("chunk", "heading", "text").repartition(tasks, "chunk")
    return places(dealt, lexed).groupBy("chunk", "lexeme").agg((F.sum("w") / 10).alias("weight"))


def keyword_hits(passages: DataFrame, questions: DataFrame, k: int = CANDIDATES, lexed=lexemes) -> DataFrame:
    """Passages by the share of a question's distinct terms they contain, then by weighted places.

    As any term may match, every place of one is a cover of its own, and cover density is the sum of the places' weights.
    ``lexed`` makes search tokens of a text column; ``functions.stemming.stemmed`` finds other forms of a word too.

    Up to ``BROADCAST_TERMS`` terms meet the passages' places where these are made, and only what matches is shuffled. More
    are joined with sums by passage and lexeme.
    """
    asked = questions.select("question", F.array_distinct(lexed(F.col("text"))).alias("terms")).where(F.size("terms") > 0)
    asked = asked.select("question", F.size("terms").alias("n_terms"), F.explode("terms").alias("lexeme"))
    if asked.count() <= BROADCAST_TERMS:
        met = places(passages, lexed).join(F.broadcast(asked), "lexeme")
        matched = met.groupBy("question", "chunk").agg((F.size(F.collect_set("lexeme")) / F.max("n_terms")).alias("score"), F.round(F.sum("w") / 10, 6).alias("density"))
    else:
        matched = postings(passages, lexed).join(asked, "lexeme").groupBy("question", "chunk").agg((F.count("*") / F.max("n_terms")).alias("score"), F.round(F.sum("weight"), 6).alias("density"))
    return ranked(matched, k, F.col("score").desc(), F.col("density").desc())


def section_hits(passages: DataFrame, questions: DataFrame, dim: int, k: int = SECTION_CANDIDATES) -> DataFrame:
    """Passages of the sections whose titles match a question clearly better than the fifth best does."""
    headed = passages.where("heading IS NOT NULL AND heading_counts IS NOT NULL")
    titles = headed.groupBy("heading").agg(F.first("heading_counts").alias("counts"))
    both = nearest(titles, "heading", questions, dim, 5)
    order = Window.partitionBy("question").orderBy(F.col("sim").desc_nulls_last(), "heading")
    top = both.withColumn("nth", F.row_number().over(order)).where("nth <= 5")
    spread = top.groupBy("question").agg(F.max(F.when(F.col("nth") == 1, F.col("sim"))).alias("best"), F.max(F.when(F.col("nth") == 5, F.col("sim"))).alias("fifth"))
    clear = spread.where(F.round(F.col("best") - F.col("fifth"), DIGITS) >= SECTION_DISTINCT_MARGIN)
    chosen = top.join(clear, "question").where(F.round(F.col("best") - F.col("sim"), DIGITS) <= SECTION_TIE_MARGIN).select("question", "heading")
    own = questions.select("question", F.col("counts").alias("q"))
    hits = passages.select("chunk", "heading", "counts").join(chosen, "heading").join(own, "question")
    lengths = norm(F.col("counts")) * norm(F.col("q"))
    score = F.round(F.when(lengths > 0, dot(F.col("counts"), F.col("q"), dim) / lengths), DIGITS)
    return ranked(hits.select("question", "chunk", score.alias("score")), k, F.col("score").desc_nulls_last())


def overview_hits(passages: DataFrame, questions: DataFrame, dim: int, k: int = OVERVIEW_CANDIDATES) -> DataFrame:
    """For definitional questions, the best passages of overview sections."""
    return vector_hits(passages.where(is_overview(F.col("heading"))), questions.where(is_definitional(F.col("text"))), dim, k)


def fuse(lists: list[tuple[DataFrame, float]], k: int | None = TOP_K) -> DataFrame:
    """Weighted reciprocal ranks, summed; ties keep the order of first appearance (list by list)."""
    parts = [hits.select("question", "chunk", F.lit(n).alias("list"), "rank", (F.lit(weight) / (RRF_K + F.col("rank"))).alias("part")) for n, (hits, weight) in enumerate(lists)]
    every = reduce(DataFrame.unionByName, parts)
    fused = every.groupBy("question", "chunk").agg(F.round(F.sum("part"), 12).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    order = Window.partitionBy("question").orderBy(F.col("score").desc(), "seen", "chunk")
    fused = fused.withColumn("rank", F.row_number().over(order)).drop("seen")
    return fused if k is None else fused.where(F.col("rank") <= k)


def gate(questions: DataFrame, vector: DataFrame, keyword: DataFrame, threshold: float) -> DataFrame:
    """(question, best_sim, best_coverage, relevant): whether anything found is about the question."""
    sim = vector.groupBy("question").agg(F.max("score").alias("best_sim"))
    coverage = keyword.groupBy("question").agg(F.max("score").alias("best_coverage"))
    rows = questions.select("question").join(sim, "question", "left").join(coverage, "question", "left")
    rows = rows.select("question", F.coalesce("best_sim", F.lit(0.0)).alias("best_sim"), F.coalesce("best_coverage", F.lit(0.0)).alias("best_coverage"))
    relevant = (F.col("best_sim") >= threshold) | ((F.col("best_coverage") >= KEYWORD_COVERAGE) & (F.col("best_sim") >= threshold - SIMILARITY_SLACK))
    return rows.withColumn("relevant", relevant)


def ranked_lists(passages: DataFrame, questions: DataFrame, dim: int, texts: DataFrame | None = None) -> list[tuple[DataFrame, float]]:
    """The lists to be fused. ``texts`` (chunk, heading, text) is where words are read, if not from the passages."""
    return [
        (vector_hits(passages, questions, dim), VECTOR_WEIGHT),
        (keyword_hits(passages if texts is None else texts, questions), KEYWORD_WEIGHT),
        (section_hits(passages, questions, dim), SECTION_WEIGHT),
        (overview_hits(passages, questions, dim), OVERVIEW_WEIGHT),
    ]


def retrieve(passages: DataFrame, questions: DataFrame, files: DataFrame, dim: int, k: int = TOP_K, *, texts: DataFrame | None = None, projects: Sequence[int] | None = None, lists: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Fused hits with similarity and keyword rank; files that are not indexed drop out after the cut.

    ``projects`` restricts every list (None: all projects). The passages' ids and vectors, the questions and the lists are
    written once each; texts are not among them. ``lists`` are the vector and the keyword list, if they are at hand.
    """
    texts = of_projects(passages if texts is None else texts, projects).select("chunk", "heading", "text")
    slim, questions = written(of_projects(passages, projects).select("chunk", "heading", "counts", "heading_counts")), written(questions)
    known = dict(enumerate(lists or ()))
    every = [(known[n] if n in known else written(hits.select("question", "chunk", "score", "rank")), w) for n, (hits, w) in enumerate(ranked_lists(slim, questions, dim, texts))]
    fused = fuse(every, k)
    sim = every[0][0].select("question", "chunk", F.col("score").alias("similarity"))
    keyword = every[1][0].select("question", "chunk", F.col("rank").alias("keyword_rank"))
    hits = fused.join(sim, ["question", "chunk"], "left").join(keyword, ["question", "chunk"], "left")
    return hits.join(files.where("status = 'indexed'").select(F.col("file").alias("chunk"), "status"), "chunk").drop("status")


def related(hits: DataFrame, most: int = 3) -> DataFrame:
    """What is shown when nothing is relevant: of the first hits, those that are similar at all."""
    return hits.where((F.col("rank") <= most) & (F.coalesce("similarity", F.lit(0.0)) >= RELATED_SIMILARITY))


def pack(hits: DataFrame, context_length: int, prompt_tokens: Column) -> DataFrame:
    """The longest prefix of the hits (question, rank, header, text) that fits the budget beside prompt and answer."""
    cost = estimated_tokens(F.concat("header", "text")) + SOURCE_OVERHEAD
    budget = context_length - ANSWER_RESERVE_TOKENS - prompt_tokens - PROMPT_SLACK
    order = Window.partitionBy("question").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(cost).over(order)).where(F.col("used") <= budget)


def next_pages(sources: DataFrame) -> DataFrame:
    """(place, next_place): which source goes on with which, on the next page of the same file and section.

    Of sources at the same place in a file the last one counts.
    """
    at = sources.where("page > 0").groupBy("file", "section", "page").agg(F.max("place").alias("next_place"))
    following = at.select(F.col("file").alias("f"), F.col("section").alias("s"), (F.col("page") - 1).alias("p"), "next_place")
    rows = sources.where("page > 0")
    return rows.join(following, (rows.file == F.col("f")) & rows.section.eqNullSafe(F.col("s")) & (rows.page == F.col("p"))).select("place", "next_place")
