"""Queries over texts: functions of one row, segments, search, fusion, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.constants import MIN_SIMILARITY
from lodestar.functions import text as T
from lodestar.functions.stemming import stemmed
from lodestar.functions.vectors import hashed_counts, unit, with_counts
from lodestar.lineage import written
from lodestar.operators import search
from lodestar.plans.base import Query
from lodestar.sources import store
from lodestar.sources.segments import markdown_sections, paragraph_units, text_windows

DIM = 64
THRESHOLD = MIN_SIMILARITY["bge-m3"]

STOP = ", ".join(f"'{w}'" for w in T.ENGLISH_STOP)
CAMEL = "regexp_replace(coalesce({0}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"


def squeezed(e: str) -> str:
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def lexemes(e: str) -> str:
    return f"list_filter(regexp_extract_all(lower({CAMEL.format(e)}), '[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ({STOP}))"


def counts(name: str, source: str, key: str, text: str) -> str:
    """CTEs that end in ``name`` (key, counts): the hashed bag of words of each row of ``source``."""
    return f"""
    {name}_w AS (SELECT {key} AS id, unnest(list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda w: len(w) >= 3)) AS w FROM {source}),
    {name}_b AS (SELECT id, CAST('0x' || substr(md5(w), 31, 2) AS INT) % {DIM} AS b, count(*) AS n FROM {name}_w GROUP BY ALL),
    {name}_v AS (SELECT s.{key} AS id, list(coalesce(k.n, 0)::DOUBLE ORDER BY r.b) AS v FROM {source} s CROSS JOIN range({DIM}) r(b) LEFT JOIN {name}_b k ON k.id = s.{key} AND k.b = r.b GROUP BY s.{key}),
    {name} AS (SELECT id, CASE WHEN list_sum(v) = 0 THEN list_concat([1.0::DOUBLE], list_slice(v, 2, {DIM})) ELSE v END AS counts FROM {name}_v)"""


def cosine(a: str, b: str) -> str:
    return f"round(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 9)"


TITLE = "regexp_replace(" + CAMEL.format("array_to_string(list_transform(string_split(heading, ' › '), lambda p: regexp_replace(p, '^[0-9]+(\\.[0-9]+)*\\s+', '')), ' › ')") + ", '', '')"
DEFINITIONAL = (
    "(regexp_matches({0}, '" + T.DEFINITIONAL.replace("'", "''") + "') AND NOT regexp_matches({0}, '" + T.NOT_DEFINITIONAL + "') AND len(list_filter(string_split_regex(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) <= 10)"
)

def lists(table: str = "passages") -> str:
    """CTEs of all ranked lists over the passages of a table, and of what they are fused to."""
    return (
    counts("pv", table, "chunk", "text")
    + ","
    + counts("hv", table, "chunk", TITLE)
    + ","
    + counts("qv", "asked", "question", "text")
    + f""",
    vec AS (SELECT q.id AS question, p.id AS chunk, {cosine("p.counts", "q.counts")} AS score FROM pv p, qv q),
    vector AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC NULLS LAST, chunk) AS rank FROM vec QUALIFY rank <= 40),
    post AS (SELECT chunk, unnest({lexemes("heading")}) AS lexeme, 10 AS w FROM {table} UNION ALL SELECT chunk, unnest({lexemes("text")}), 1 FROM {table}),
    posting AS (SELECT chunk, lexeme, sum(w) / 10.0::DOUBLE AS weight FROM post GROUP BY ALL),
    qt AS (SELECT question, len(list_distinct({lexemes("text")})) AS n_terms, unnest(list_distinct({lexemes("text")})) AS lexeme FROM asked),
    kw AS (SELECT question, chunk, count(*) / max(n_terms)::DOUBLE AS score, round(sum(weight), 6) AS density FROM posting JOIN qt USING (lexeme) GROUP BY ALL),
    keyword AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, density DESC, chunk) AS rank FROM kw QUALIFY rank <= 40),
    titles AS (SELECT heading, any_value(h.counts) AS counts FROM {table} p JOIN hv h ON h.id = p.chunk WHERE heading IS NOT NULL GROUP BY heading),
    best5 AS (SELECT q.id AS question, t.heading, {cosine("t.counts", "q.counts")} AS sim, row_number() OVER (PARTITION BY q.id ORDER BY {cosine("t.counts", "q.counts")} DESC NULLS LAST, heading) AS nth FROM titles t, qv q QUALIFY nth <= 5),
    clear AS (SELECT question, max(sim) FILTER (nth = 1) AS best, max(sim) FILTER (nth = 5) AS fifth FROM best5 GROUP BY question HAVING round(best - fifth, 9) >= 0.015),
    chosen AS (SELECT b.question, b.heading FROM best5 b JOIN clear c USING (question) WHERE round(c.best - b.sim, 9) <= 0.005),
    section AS (SELECT c.question, p.chunk, v.score, row_number() OVER (PARTITION BY c.question ORDER BY v.score DESC NULLS LAST, p.chunk) AS rank FROM chosen c JOIN {table} p USING (heading) JOIN vec v ON v.question = c.question AND v.chunk = p.chunk QUALIFY rank <= 8),
    overview AS (SELECT v.question, v.chunk, v.score, row_number() OVER (PARTITION BY v.question ORDER BY v.score DESC NULLS LAST, v.chunk) AS rank FROM vec v JOIN {table} p ON p.chunk = v.chunk JOIN asked a ON a.question = v.question
      WHERE regexp_matches(p.heading, '{T.OVERVIEW}') AND {DEFINITIONAL.format("a.text")} QUALIFY rank <= 3),
    lists AS (SELECT question, chunk, rank, 0 AS list, 1.0::DOUBLE / (60 + rank) AS part FROM vector UNION ALL SELECT question, chunk, rank, 1, 1.0::DOUBLE / (60 + rank) FROM keyword
      UNION ALL SELECT question, chunk, rank, 2, 2.0::DOUBLE / (60 + rank) FROM section UNION ALL SELECT question, chunk, rank, 3, 1.5::DOUBLE / (60 + rank) FROM overview),
    sums AS (SELECT question, chunk, round(sum(part), 12) AS score, min((list, rank)) AS seen FROM lists GROUP BY ALL),
    fused AS (SELECT question, chunk, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, seen, chunk) AS rank FROM sums QUALIFY rank <= 8)
"""
)


LISTS = lists()
SEARCH = ("passages", "asked")


def prepared(passages: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passages and questions with their vectors."""
    titled = passages.withColumn("title", T.section_title(F.col("heading")))
    return with_counts(titled, DIM, counts="text", heading_counts="title").drop("title"), prepared_questions(asked)


def prepared_once(passages: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same, written: for plans that use both several times."""
    rows, questions = prepared(passages, asked)
    return written(rows), written(questions)


def keyword(**options):
    return lambda p, a: search.keyword_hits(p, a, **options).select("question", "chunk", "score", "rank")


def retrieved(p: DataFrame, a: DataFrame, f: DataFrame, projects: list[int] | None = None) -> DataFrame:
    return search.retrieve(*prepared(p, a), f, DIM, texts=p, projects=projects)


def cards(p: DataFrame, a: DataFrame, f: DataFrame) -> DataFrame:
    rows = retrieved(p, a, f).join(p, "chunk")
    label = T.location_label(F.lit("page"), page=F.col("chunk"))
    return rows.select("question", "rank", "chunk", label.alias("label"), T.source_header(F.lit("page.pdf"), label, F.col("heading")).alias("header"), T.snippet(F.col("text")).alias("snippet"), T.open_url(F.col("chunk"), F.lit("pdf"), F.col("rank")).alias("open_url"))


def packed(p: DataFrame, a: DataFrame, f: DataFrame) -> DataFrame:
    rows = retrieved(p, a, f).join(p.select("chunk", "heading", "text"), "chunk").join(a.select("question", F.col("text").alias("asked")), "question")
    rows = rows.withColumn("header", T.source_header(F.lit("page.pdf"), T.location_label(F.lit("page"), page=F.col("chunk")), F.col("heading")))
    kept = search.pack(rows.withColumn("prompt", F.lit(300) + T.estimated_tokens(F.col("asked"))), 4_096, F.col("prompt"))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("header"), F.lit("\n"), F.col("text"))
    return kept.select("question", "rank", "chunk", "used", F.md5(block.cast("binary")).alias("block_md5"))


PACKED_SQL = """
hits AS (SELECT f.question, f.rank, f.chunk, p.text, a.text AS asked, concat('[Source: page.pdf | Page ', p.chunk, CASE WHEN p.heading <> '' THEN concat(' | ', p.heading) ELSE '' END, ']') AS header
  FROM fused f JOIN page_files s ON s.file = f.chunk AND s.status = 'indexed' JOIN passages p ON p.chunk = f.chunk JOIN asked a ON a.question = f.question),
used AS (SELECT *, sum(floor(len(header || text) / 3.5)::BIGINT + 1 + 8) OVER (PARTITION BY question ORDER BY rank) AS used FROM hits)
"""
SNIPPET = "trim(regexp_replace(regexp_replace(text, '\\[Screenshot text\\]\\s*', '', 'g'), '\\s+', ' ', 'g'))"
LINES = "SELECT id, unnest(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)), 1) AS n"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"

def cache_misses(messages):
    """Users' messages whose text no other role has said: the others' are in the cache."""
    passages = messages.withColumnRenamed("content", "passage")
    cache = passages.where("role <> 'user'").select(store.text_hash("model").alias("text_hash"))
    return store.embed_missing(passages.where("role = 'user'"), cache, "model", lambda new: new.select("text_hash"))


QUERIES: dict[str, Query] = {
    "search_text_normalise": Query(("documents",), lambda d: d.select("id", F.md5(T.search_text(F.col("text")).cast("binary")).alias("h")), f"SELECT id, md5({CAMEL.format('text')}) AS h FROM documents"),
    "section_titles": Query(("passages",), lambda p: p.select("chunk", T.section_title(F.concat(F.lit("3.1 "), "heading", F.lit(" › 2 RequestToken"))).alias("title")), "SELECT chunk, title FROM (SELECT chunk, concat('3.1 ', heading, ' › 2 RequestToken') AS heading FROM passages) x, LATERAL (SELECT " + TITLE + " AS title)"),
    "location_labels": Query(
        ("observations",),
        lambda o: o.select(
            "id",
            T.location_label(
                F.element_at(F.array(*[F.lit(k) for k in ("page", "slide", "time", "sheet_rows", "heading", "lines")]), (F.col("id") % 6 + 1).cast("int")),
                page=F.col("file_id"), first=F.col("size_bytes"), last=F.col("id"), heading=F.lit("Setup"), sheet=F.lit("S1"), row_first=F.col("file_id"), row_last=F.col("id"), t_first=F.col("file_id"), t_last=F.col("id"),
            ).alias("label"),
        ),
        """WITH t AS (SELECT *, (CASE WHEN file_id // 3600 > 0 THEN concat(file_id // 3600, ':', lpad((file_id % 3600 // 60)::VARCHAR, 2, '0')) ELSE (file_id // 60)::VARCHAR END) || ':' || lpad((file_id % 60)::VARCHAR, 2, '0') AS a,
        (CASE WHEN id // 3600 > 0 THEN concat(id // 3600, ':', lpad((id % 3600 // 60)::VARCHAR, 2, '0')) ELSE (id // 60)::VARCHAR END) || ':' || lpad((id % 60)::VARCHAR, 2, '0') AS b FROM observations)
        SELECT id, CASE id % 6 WHEN 0 THEN concat('Page ', file_id) WHEN 1 THEN concat('Slide ', file_id) WHEN 2 THEN concat(a, '–', b) WHEN 3 THEN concat('Sheet S1, rows ', file_id, '–', id)
        WHEN 4 THEN concat('Section “Setup”, lines ', size_bytes, '–', id) ELSE concat('Lines ', size_bytes, '–', id) END AS label FROM t""",
    ),
    "snippets": Query(("documents",), lambda d: d.select("id", T.snippet(F.col("text")).alias("snippet")), f"SELECT id, CASE WHEN len(t) <= 260 THEN t ELSE regexp_replace(substring(t, 1, 260), ' [^ ]*$', '') || '…' END AS snippet FROM (SELECT id, {SNIPPET} AS t FROM documents)"),
    "open_urls": Query(("files",), lambda f: f.select("id", T.open_url(F.col("id"), F.when(F.col("id") % 2 == 0, "pdf").otherwise("text"), F.col("project_id")).alias("url")), "SELECT id, concat('/api/files/', id, CASE WHEN id % 2 = 0 THEN concat('/pdf', CASE WHEN project_id > 0 THEN concat('#page=', project_id) ELSE '' END) ELSE '/content' END) AS url FROM files"),
    "token_estimate": Query(("documents",), lambda d: d.select("id", T.estimated_tokens(F.col("text")).alias("by_length"), T.fallback_tokens(F.col("text")).alias("by_words")), f"SELECT id, floor(len(text) / 3.5)::BIGINT + 1 AS by_length, greatest(1, round_even(len(list_filter(string_split({squeezed('text')}, ' '), lambda w: w <> '')) * 1.3::DOUBLE, 0)::BIGINT) AS by_words FROM documents"),
    "content_filter": Query(("passages",), lambda p: p.select("chunk", T.has_content(F.col("text"), F.concat(F.lit("1 A › "), "text")).alias("of_itself"), T.has_content(F.substring("text", 1, 2)).alias("short"), T.has_content(F.col("text"), F.col("heading")).alias("kept")), f"SELECT chunk, false AS of_itself, len(regexp_replace(substring(text, 1, 2), '[^\\p{{L}}]', '', 'g')) >= 3 AS short, len(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 3 AND lower({squeezed('text')}) <> lower({squeezed('heading')}) AS kept FROM passages"),
    "contents_pages": Query(("documents",), lambda d: d.select("id", T.is_contents_page(F.concat("text", F.repeat(F.lit("...."), (F.col("id") % 9).cast("int")))).alias("contents")), "SELECT id, len(regexp_extract_all(text || repeat('....', (id % 9)::INT), '\\.{4}')) >= 5 AS contents FROM documents"),
    "definitional_questions": Query(("prompts",), lambda p: p.select("id", T.is_definitional(F.col("text")).alias("definitional")), f"SELECT id, {DEFINITIONAL.format('text')} AS definitional FROM prompts"),
    "text_windows": Query(
        ("documents",),
        lambda d: text_windows(d.select("id", "text")).select("id", "line_start", "line_end", F.md5(F.col("segment").cast("binary")).alias("h")),
        f"""WITH l AS ({LINES} FROM documents WHERE text <> ''),
        w AS (SELECT id, (n - 1) // 60 * 60 + 1 AS line_start, max(n) AS line_end, {STRIP.format("string_agg(line, chr(10) ORDER BY n)")} AS s FROM l GROUP BY id, (n - 1) // 60)
        SELECT id, line_start, line_end, md5(s) AS h FROM w WHERE s <> ''""",
    ),
    "markdown_sections": Query(
        ("marked",),
        lambda d: markdown_sections(d).select("id", "loc_type", "heading", "line_start", "line_end", F.md5(F.col("segment").cast("binary")).alias("h")),
        f"""WITH l AS ({LINES} FROM marked WHERE text <> ''),
        g AS (SELECT *, regexp_matches(line, '^(#{{1,6}})\\s+(.*?)\\s*#*\\s*$') AS is_head, sum(CASE WHEN regexp_matches(line, '^(#{{1,6}})\\s+(.*?)\\s*#*\\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS sec FROM l),
        s AS (SELECT id, sec, min(n) AS line_start, max(n) AS line_end, {STRIP.format("string_agg(line, chr(10) ORDER BY n)")} AS t, arg_min(line, n) AS first FROM g GROUP BY id, sec)
        SELECT id, CASE WHEN sec > 0 THEN 'heading' ELSE 'lines' END AS loc_type, CASE WHEN sec > 0 THEN regexp_extract(first, '^(#{{1,6}})\\s+(.*?)\\s*#*\\s*$', 2) END AS heading, line_start, line_end, md5(t) AS h FROM s WHERE t <> ''""",
    ),
    "paragraph_units": Query(
        ("spaced",),
        lambda d: d.select("id", F.posexplode(paragraph_units(F.col("text"))).alias("place", "unit")).select("id", "place", F.md5(F.col("unit").cast("binary")).alias("h")),
        f"""WITH p AS (SELECT id, unnest(string_split_regex(text, '\\n\\s*\\n')) AS p, generate_subscripts(string_split_regex(text, '\\n\\s*\\n'), 1) AS n FROM spaced),
        u AS (SELECT id, n, {STRIP.format("p")} AS p FROM p),
        s AS (SELECT id, n, unnest(CASE WHEN len(p) > 600 THEN string_split(regexp_replace(p, '([.!?])\\s+([A-Z0-9"''(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) ELSE [p] END) AS u,
          generate_subscripts(CASE WHEN len(p) > 600 THEN string_split(regexp_replace(p, '([.!?])\\s+([A-Z0-9"''(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) ELSE [p] END, 1) AS m FROM u WHERE p <> '')
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY n, m) - 1 AS place, md5({STRIP.format("u")}) AS h FROM s WHERE {STRIP.format("u")} <> ''""",
    ),
    "hash_embedding": Query(
        ("asked",),
        lambda a: hashed_counts(a, "question", "text", DIM).select(F.col("id").alias("question"), F.transform(unit(F.col("counts")), lambda x: F.round(x, 9)).alias("vector")),
        "WITH " + counts("v", "asked", "question", "text") + " SELECT id AS question, list_transform(counts, lambda x: round(x / sqrt(list_dot_product(counts, counts)), 9)) AS vector FROM v",
    ),
    "embedding_cache_misses": Query(
        ("messages",),
        cache_misses,
        "SELECT DISTINCT sha256(concat('model', chr(0), content)) AS text_hash FROM messages u WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM messages c WHERE c.role <> 'user' AND c.content = u.content)",
    ),
    "vector_topk": Query(
        ("vectors", "asked"),
        lambda v, a: search.vector_hits(v.select(F.col("id").alias("chunk"), F.col("embedding").alias("counts")), prepared_questions(a), DIM).select("question", "chunk", "score", "rank"),
        "WITH " + counts("qv", "asked", "question", "text") + f", s AS (SELECT q.id AS question, v.id AS chunk, {cosine('v.e', 'q.counts')} AS score FROM (SELECT id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM vectors) v, qv q) SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC NULLS LAST, chunk) AS rank FROM s QUALIFY rank <= 40",
    ),
    "vector_topk_by_project": Query(
        ("vectors", "asked"),
        lambda v, a: search.vector_hits(v.select(F.col("id").alias("chunk"), F.col("embedding").alias("counts"), "project"), prepared_questions(a), DIM, within=F.col("project").isin(1, 4, 7)).select("question", "chunk", "score", "rank"),
        "WITH " + counts("qv", "asked", "question", "text") + f", s AS (SELECT q.id AS question, v.id AS chunk, {cosine('v.e', 'q.counts')} AS score FROM (SELECT id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM vectors WHERE project IN (1, 4, 7)) v, qv q) SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC NULLS LAST, chunk) AS rank FROM s QUALIFY rank <= 40",
    ),
    "keyword_coverage": Query(SEARCH, keyword(), "WITH " + LISTS + " SELECT question, chunk, score, rank FROM keyword"),
    "keyword_density": Query(("passages",), lambda p: search.postings(p).select("chunk", "lexeme", F.round("weight", 6).alias("weight")), f"WITH post AS (SELECT chunk, unnest({lexemes('heading')}) AS lexeme, 10 AS w FROM passages UNION ALL SELECT chunk, unnest({lexemes('text')}), 1 FROM passages) SELECT chunk, lexeme, round(sum(w) / 10.0::DOUBLE, 6) AS weight FROM post GROUP BY ALL"),
    "keyword_stemmed": Query(SEARCH, keyword(lexed=stemmed)),
    "section_match": Query(SEARCH, lambda p, a: search.section_hits(*prepared_once(p, a), DIM).select("question", "chunk", "score", "rank"), "WITH " + LISTS + " SELECT question, chunk, score, rank FROM section"),
    "overview_hits": Query(
        ("passages", "definitions"),
        lambda p, a: search.overview_hits(*prepared(p.withColumn("heading", F.when(F.col("chunk") % 3 == 0, "2 Overview").otherwise(F.col("heading"))), a), DIM).select("question", "chunk", "score", "rank"),
        "WITH " + counts("pv", "passages", "chunk", "text") + "," + counts("qv", "definitions", "question", "text") + f""" SELECT q.id AS question, p.id AS chunk, {cosine('p.counts', 'q.counts')} AS score, row_number() OVER (PARTITION BY q.id ORDER BY {cosine('p.counts', 'q.counts')} DESC, p.id) AS rank
        FROM pv p JOIN passages t ON t.chunk = p.id, qv q JOIN definitions a ON a.question = q.id WHERE regexp_matches(CASE WHEN t.chunk % 3 = 0 THEN '2 Overview' ELSE t.heading END, '{T.OVERVIEW}') AND {DEFINITIONAL.format("a.text")} QUALIFY rank <= 3""",
    ),
    "rrf_fusion": Query(SEARCH, lambda p, a: search.fuse(search.ranked_lists(*prepared_once(p, a), DIM)).select("question", "chunk", "score", "rank"), "WITH " + LISTS + " SELECT question, chunk, score, rank FROM fused"),
    "relevance_gate": Query(
        SEARCH,
        lambda p, a: (lambda x, q: search.gate(q, search.vector_hits(x, q, DIM), search.keyword_hits(x, q), THRESHOLD))(*prepared_once(p, a)),
        "WITH " + LISTS + """, b AS (SELECT a.question, coalesce((SELECT max(score) FROM vector v WHERE v.question = a.question), 0) AS best_sim, coalesce((SELECT max(score) FROM keyword k WHERE k.question = a.question), 0) AS best_coverage FROM asked a)
        SELECT *, best_sim >= 0.45 OR (best_coverage >= 0.75 AND best_sim >= 0.45 - 0.08) AS relevant FROM b""",
    ),
    "hybrid_retrieve": Query(
        (*SEARCH, "page_files"),
        retrieved,
        "WITH " + LISTS + " SELECT f.question, f.chunk, f.score, f.rank, v.score AS similarity, k.rank AS keyword_rank FROM fused f JOIN page_files s ON s.file = f.chunk AND s.status = 'indexed' LEFT JOIN vector v ON v.question = f.question AND v.chunk = f.chunk LEFT JOIN keyword k ON k.question = f.question AND k.chunk = f.chunk",
    ),
    "hybrid_retrieve_by_project": Query(
        (*SEARCH, "page_files"),
        lambda p, a, f: retrieved(p, a, f, [1, 3]),
        "WITH seen AS (SELECT * FROM passages WHERE project IN (1, 3)), " + lists("seen")
        + " SELECT f.question, f.chunk, f.score, f.rank, v.score AS similarity, k.rank AS keyword_rank FROM fused f JOIN page_files s ON s.file = f.chunk AND s.status = 'indexed' LEFT JOIN vector v ON v.question = f.question AND v.chunk = f.chunk LEFT JOIN keyword k ON k.question = f.question AND k.chunk = f.chunk",
    ),
    "hybrid_retrieve_no_project": Query((*SEARCH, "page_files"), lambda p, a, f: retrieved(p, a, f, []), "SELECT question, question AS chunk, 0.0::DOUBLE AS score, 1 AS rank, 0.0::DOUBLE AS similarity, 1 AS keyword_rank FROM asked WHERE false"),
    "late_status_join": Query(
        (*SEARCH, "page_files"),
        lambda p, a, f: search.fuse(search.ranked_lists(*prepared_once(p, a), DIM)).join(f.select(F.col("file").alias("chunk"), "status"), "chunk").select("question", "chunk", "rank", (F.col("status") == "indexed").alias("kept")),
        "WITH " + LISTS + " SELECT f.question, f.chunk, f.rank, s.status = 'indexed' AS kept FROM fused f JOIN page_files s ON s.file = f.chunk",
    ),
    "related_sources": Query(
        (*SEARCH, "page_files"),
        lambda p, a, f: search.related(retrieved(p, a, f)).select("question", "chunk", "rank"),
        "WITH " + LISTS + " SELECT f.question, f.chunk, f.rank FROM fused f JOIN page_files s ON s.file = f.chunk AND s.status = 'indexed' LEFT JOIN vector v ON v.question = f.question AND v.chunk = f.chunk WHERE f.rank <= 3 AND coalesce(v.score, 0) >= 0.3",
    ),
    "source_cards": Query(
        (*SEARCH, "page_files"),
        cards,
        "WITH " + LISTS + f""", t AS (SELECT f.question, f.rank, f.chunk, p.heading, {SNIPPET.replace('text,', 'p.text,')} AS t FROM fused f JOIN page_files s ON s.file = f.chunk AND s.status = 'indexed' JOIN passages p ON p.chunk = f.chunk)
        SELECT question, rank, chunk, concat('Page ', chunk) AS label, concat('[Source: page.pdf | Page ', chunk, CASE WHEN heading <> '' THEN concat(' | ', heading) ELSE '' END, ']') AS header,
        CASE WHEN len(t) <= 260 THEN t ELSE regexp_replace(substring(t, 1, 260), ' [^ ]*$', '') || '…' END AS snippet, concat('/api/files/', chunk, '/pdf#page=', rank) AS open_url FROM t""",
    ),
    "source_packing": Query(
        (*SEARCH, "page_files"),
        packed,
        "WITH " + LISTS + "," + PACKED_SQL + " SELECT question, rank, chunk, used::BIGINT AS used, md5(concat('[', rank, '] ', header, chr(10), text)) AS block_md5 FROM used WHERE used <= 4096 - 1024 - (300 + floor(len(asked) / 3.5)::BIGINT + 1) - 50",
    ),
    "next_page_links": Query(
        ("places",),
        search.next_pages,
        """WITH a AS (SELECT file, section, page, max(place) AS next_place FROM places WHERE page > 0 GROUP BY ALL)
        SELECT p.place, a.next_place FROM places p JOIN a ON a.file = p.file AND a.section IS NOT DISTINCT FROM p.section AND a.page = p.page + 1 WHERE p.page > 0""",
    ),
}


def prepared_questions(asked: DataFrame) -> DataFrame:
    return with_counts(asked, DIM, counts="text")
