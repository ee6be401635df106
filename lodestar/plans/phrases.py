"""Phrase queries: every stretch of a few words of a question, looked for in passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import tokens as K
from lodestar.functions.text import words_of
from lodestar.operators.phrases import phrase_hits
from lodestar.plans.base import Query
from lodestar.plans.texts import CAMEL, STOP

WORDS = 4


def stretches(asked: DataFrame) -> DataFrame:
    """(question, text): every run of WORDS words of a question's text, numbered within it."""
    words = words_of(F.coalesce("text", F.lit("")))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - WORDS + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(WORDS)), " "))
    return asked.select("question", F.posexplode(runs).alias("at", "text")).select((F.col("question") * 10_000 + F.col("at")).alias("question"), "text")


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def token_ctes(name: str, source: str, keys: str, text: str) -> str:
    """CTEs that end in ``name`` (keys, token, kind, pos), a row for each token."""
    kinds = " ".join(f"WHEN regexp_full_match(t, '{quoted(p)}') THEN '{k}'" for k, p in K.KINDS.items())
    return f"""
    {name}_r AS (SELECT {keys}, regexp_extract_all(lower({CAMEL.format(text)}), '{quoted(K.TOKEN)}') AS l FROM {source}),
    {name}_t AS (SELECT {keys}, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM {name}_r),
    {name}_k AS (SELECT *, CASE {kinds} ELSE 'word' END AS kind, regexp_replace(t, '^{K.SCHEME}', '') AS bare FROM {name}_t),
    {name}_e AS (SELECT *, CASE kind WHEN 'url' THEN [bare, regexp_extract(bare, '^([^/]*)', 1), regexp_extract(bare, '(/.*)$', 1)] WHEN 'hyphenated' THEN list_concat([t], string_split(t, '-')) WHEN 'host' THEN [bare] ELSE [t] END AS parts,
      CASE kind WHEN 'url' THEN ['url', 'host', 'path'] WHEN 'hyphenated' THEN list_concat(['hyphenated'], list_transform(string_split(t, '-'), lambda x: 'word')) ELSE [kind] END AS kinds FROM {name}_k),
    {name}_u AS (SELECT {keys}, i, unnest(parts) AS token, unnest(kinds) AS kind, generate_subscripts(parts, 1) AS j FROM {name}_e),
    {name} AS (SELECT {keys}, token, kind, row_number() OVER (PARTITION BY {keys} ORDER BY i, j) AS pos FROM {name}_u)"""


PHRASES = f"""WITH words AS (SELECT question, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM asked),
    runs AS (SELECT question * 10000 + i AS question, array_to_string(list_slice(w, i + 1, i + {WORDS}), ' ') AS text FROM (SELECT *, unnest(range(0, greatest(len(w) - {WORDS} + 1, 1))) AS i FROM words)),
    {token_ctes("q", "runs", "question", "text")}, {token_ctes("h", "passages", "chunk", "heading")}, {token_ctes("b", "passages", "chunk", "text")},
    size AS (SELECT chunk, count(*) AS n FROM h GROUP BY chunk),
    place AS (SELECT chunk, token, pos, 10 AS w FROM h WHERE NOT (kind = 'word' AND token IN ({STOP})) UNION ALL SELECT b.chunk, token, pos + coalesce(n, 0), 1 FROM b LEFT JOIN size USING (chunk) WHERE NOT (kind = 'word' AND token IN ({STOP}))),
    term AS (SELECT *, pos - min(pos) OVER (PARTITION BY question) AS off, count(*) OVER (PARTITION BY question) AS n, max(pos) OVER (PARTITION BY question) - min(pos) OVER (PARTITION BY question) + 1 - count(*) OVER (PARTITION BY question) AS gaps
      FROM q WHERE NOT (kind = 'word' AND token IN ({STOP}))),
    cover AS (SELECT question, chunk, p.pos - off AS start, count(*) AS there, max(n) AS n, max(gaps) AS gaps, sum(10.0::DOUBLE / w) AS inverse FROM place p JOIN term USING (token) GROUP BY ALL HAVING there = max(n)),
    hit AS (SELECT question, chunk, round(sum(n / inverse / (1 + gaps)), 9) AS score, count(*) AS covers FROM cover GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, chunk) AS rank FROM hit QUALIFY rank <= 40"""

QUERIES: dict[str, Query] = {
    "keyword_phrases": Query(("passages", "asked"), lambda p, a: phrase_hits(p, stretches(a)).select("question", "chunk", "score", "covers", "rank"), PHRASES),
    "search_tokens": Query(
        ("documents",),
        lambda d: d.select("id", F.explode(K.tokens(F.col("text"))).alias("t")).select("id", "t.token", "t.kind", F.col("t.pos").cast("long").alias("pos")),
        "WITH " + token_ctes("d", "documents", "id", "text").strip() + " SELECT id, token, kind, pos FROM d",
    ),
}
