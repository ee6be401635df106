"""Queries over answers: the assistant's messages, with the other messages of the conversation as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.constants import NOT_FOUND, QUESTION_WORDS, STOP_WORDS
from lodestar.functions import text as T
from lodestar.functions.answer_text import BULLET, HEDGE, MARKER, tidied
from lodestar.functions.code_blocks import END_HEADINGS, guarded, likeliest
from lodestar.operators import answers as A
from lodestar.operators import chunking as C
from lodestar.plans.base import Query
from lodestar.sources.segments import text_windows
from lodestar.streaming import watch

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
ASKING = ", ".join(f"'{w}'" for w in (*STOP_WORDS, *QUESTION_WORDS))


def with_sources(messages: DataFrame, but_question: bool = False) -> DataFrame:
    """(conv_id, turn, answer, question, sources): sources are the conversation's other messages by turn.

    A conversation's messages are in one array: a conversation is what a user and a model say within one context window.
    """
    rows = messages.where("role <> 'assistant'")
    asked = F.min_by(F.struct("turn", "content"), F.when(F.col("role") == "user", F.col("turn")))
    others = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "content"))).alias("said"), asked.alias("asked"))
    said = F.filter("said", lambda m: ~m["turn"].eqNullSafe(F.col("asked.turn"))) if but_question else F.col("said")
    others = others.select("conv_id", F.transform(said, lambda m: m["content"]).alias("sources"), F.col("asked.content").alias("question"))
    answer = F.concat(F.replace("content", F.lit(". "), F.lit(" [1, 9]. ")), F.lit(" [Source 2] [0]."))
    return messages.where("role = 'assistant'").join(others, "conv_id").select("conv_id", "turn", answer.alias("answer"), "question", "sources")


def answers_sql(name: str = "answers", but_question: bool = False) -> str:
    said = "turn IS DISTINCT FROM first_turn" if but_question else "true"
    return f"""
asked AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS first_turn, arg_min(content, turn) FILTER (role = 'user') AS question FROM messages GROUP BY conv_id),
others AS (SELECT m.conv_id, any_value(question) AS question, coalesce(list(content ORDER BY turn) FILTER ({said}), []) AS sources FROM messages m JOIN asked a ON a.conv_id = m.conv_id WHERE role <> 'assistant' GROUP BY m.conv_id),
{name} AS (SELECT m.conv_id, m.turn, concat(replace(content, '. ', ' [1, 9]. '), ' [Source 2] [0].') AS answer, question, sources FROM messages m JOIN others o ON o.conv_id = m.conv_id WHERE role = 'assistant')
"""


ANSWERS = answers_sql()
#: ``given`` -> ``answers``, their markers tidied.
TIDIED = f"""
found AS (SELECT *, string_split_regex(answer, '(?i){MARKER}') AS between, list_transform(list_transform(regexp_extract_all(answer, '(?i){MARKER}'), lambda m: list_filter(list_transform(regexp_extract_all(m, '[0-9]+'), lambda x: x::INT), lambda x: x BETWEEN 1 AND len(sources))),
  lambda l: array_to_string(list_transform(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: concat('[', x, ']')), '')) AS plain FROM given),
answers AS (SELECT conv_id, turn, question, sources, answer AS raw, regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(range(1, len(between) + 1), lambda i: concat(between[i], coalesce(plain[i], ''))), ''), '[ \\t]+([.,;:])', '\\1', 'g'), '(\\S)[ \\t]{{2,}}', '\\1 ', 'g'), '^\\s+|\\s+$', '', 'g') AS answer FROM found)
"""


def terms(e: str, least: int = 3, stop: str = STOP) -> str:
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({e}), '[a-z0-9]+'), lambda w: len(w) >= {least} AND w NOT IN ({stop})), lambda w: substring(w, 1, 5)))"


SENTENCES = f"""
s0 AS (SELECT conv_id, turn, unnest(string_split(answer, chr(10))) AS line, generate_subscripts(string_split(answer, chr(10)), 1) AS ln FROM answers),
s1 AS (SELECT conv_id, turn, ln, unnest(string_split(regexp_replace(regexp_replace(line, '{BULLET}', ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS sentence,
  generate_subscripts(string_split(regexp_replace(regexp_replace(line, '{BULLET}', ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS sn FROM s0),
s2 AS (SELECT *, {terms("regexp_replace(sentence, '\\[([0-9]+)\\]', '', 'g')")} AS words FROM s1 WHERE regexp_matches(sentence, '\\S')),
s3 AS (SELECT s.*, list_transform(a.sources, lambda x: len(list_intersect(s.words, {terms("x")})) / len(s.words)::DOUBLE) AS scores FROM s2 s JOIN answers a ON a.conv_id = s.conv_id AND a.turn = s.turn WHERE len(s.words) >= 3),
graded AS (SELECT *, list_max(scores) AS best, list_position(scores, list_max(scores)) AS n FROM s3)
"""
#: ``answers`` -> ``final`` (conv_id, turn, text, changes): every sentence with the markers of what it clearly comes from.
GROUNDED = f"""
g0 AS (SELECT conv_id, turn, sources, string_split(regexp_replace(answer, '([.!?])[ \\t]*(\\[[0-9]+\\](?:[ \\t]*\\[[0-9]+\\])*)[ \\t]*', ' \\2\\1', 'g'), chr(10)) AS lines FROM answers),
g1 AS (SELECT conv_id, turn, sources, unnest(lines) AS line, generate_subscripts(lines, 1) AS ln FROM g0),
g2 AS (SELECT *, regexp_extract(line, '{BULLET}') AS mark, string_split(regexp_replace(substring(line, len(regexp_extract(line, '{BULLET}')) + 1), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM g1),
g3 AS (SELECT conv_id, turn, sources, ln, line, mark, unnest(parts) AS s, generate_subscripts(parts, 1) AS sn FROM g2),
g4 AS (SELECT *, {terms("regexp_replace(s, '\\[([0-9]+)\\]', '', 'g')")} AS words, list_transform(regexp_extract_all(s, '\\[([0-9]+)\\]', 1), lambda x: x::INT) AS old FROM g3),
g5 AS (SELECT *, list_transform(sources, lambda x: len(list_intersect(words, {terms("x")})) / greatest(len(words), 1)::DOUBLE) AS shares FROM g4),
g6 AS (SELECT *, list_max(shares) AS top, list_position(shares, list_max(shares)) AS best FROM g5),
g7 AS (SELECT *, list_transform(old, lambda x: CASE WHEN shares[x] < 0.6::DOUBLE * top THEN best ELSE x END) AS moved FROM g6),
g8 AS (SELECT *, CASE WHEN len(moved) = 0 THEN [best] ELSE list_filter(moved, lambda x, i: list_position(moved, x) = i) END AS new, rtrim(regexp_replace(s, '\\s*(?:\\[[0-9]+\\])+', '', 'g')) AS bare FROM g7),
g9 AS (SELECT *, len(words) >= 3 AND top >= 0.5 AND new <> old AS changed, regexp_extract(bare, '[.!?:;]*$') AS tail FROM g8),
gs AS (SELECT conv_id, turn, ln, any_value(mark) AS mark, string_agg(CASE WHEN changed THEN concat(left(bare, len(bare) - len(tail)), ' ', array_to_string(list_transform(new, lambda x: concat('[', x, ']')), ''), tail) ELSE s END, ' ' ORDER BY sn) AS t,
  sum(CASE WHEN changed THEN greatest(len(list_filter(old, lambda x: NOT list_contains(new, x))), 1) ELSE 0 END) AS n FROM g9 GROUP BY conv_id, turn, ln),
final AS (SELECT conv_id, turn, string_agg(mark || t, chr(10) ORDER BY ln) AS text, sum(n)::INT AS changes FROM gs GROUP BY conv_id, turn)
"""
NUMBERS = f"list_transform(regexp_extract_all(answer, '(?i){MARKER}', 1), lambda x: list_transform(string_split(x, ','), lambda n: trim(n)::INT))"


def grounded(m: DataFrame) -> DataFrame:
    rows = with_sources(m).select("conv_id", "turn", F.posexplode(A.graded(F.col("answer"), F.col("sources"))).alias("place", "g"))
    return rows.where("g.best.score >= 0.5").select("conv_id", "turn", "place", F.col("g.best.n").alias("source"), F.round("g.best.score", 9).alias("score"))


def numbered_pages(pages: DataFrame) -> DataFrame:
    """Documents of ten pages each, their texts as numbered headings and lines."""
    text = F.regexp_replace(F.regexp_replace("html", r"<h1>", F.concat(F.lit("\n"), (F.col("id") % 10 + 1).cast("string"), F.lit(" "))), r"<[^>]*>", "\n")
    return pages.select((F.col("id") / 10).cast("long").alias("id"), (F.col("id") % 10).cast("int").alias("page"), text.alias("text"))


def bookmarks(pages: DataFrame) -> DataFrame:
    """Every third document has bookmarks, on three of four pages, at levels 1, 2, 2, 3, 1, 2, ..."""
    level = F.element_at(F.array(*map(F.lit, (1, 2, 2, 3, 1, 2, 3, 3, 1, 2))), (F.col("page") + 1).cast("int"))
    marks = pages.select((F.col("id") / 10).cast("long").alias("id"), (F.col("id") % 10).cast("int").alias("page"), F.lit(0).alias("place"), "url").where("id % 3 = 0 AND page % 4 <> 3")
    return marks.select("id", "page", "place", F.when(F.col("page") == 4, 1).otherwise(level).alias("level"), F.concat(F.lit(" "), F.col("url")).alias("title"))


def sections(p: DataFrame) -> DataFrame:
    return C.numbered_sections(numbered_pages(p), bookmarks(p)).select("id", "place", "page", "section", F.md5(F.col("text").cast("binary")).alias("h"))


SECTIONS_SQL = r"""
WITH np AS (SELECT id // 10 AS id, (id % 10)::INT AS page, url, regexp_replace(regexp_replace(html, '<h1>', concat(chr(10), id % 10 + 1, ' '), 'g'), '<[^>]*>', chr(10), 'g') AS text FROM pages),
marks AS (SELECT id, page, CASE WHEN page = 4 THEN 1 ELSE [1, 2, 2, 3, 1, 2, 3, 3, 1, 2][page + 1] END AS level, trim(url) AS title FROM np WHERE id % 3 = 0 AND page % 4 <> 3),
marked AS (SELECT DISTINCT id FROM marks),
lasts AS (SELECT p.id, p.page, p.text, max((m.page, title)) FILTER (level = 1) AS a, max((m.page, title)) FILTER (level = 2) AS b, max((m.page, title)) FILTER (level = 3) AS c
  FROM np p JOIN marked k ON k.id = p.id LEFT JOIN marks m ON m.id = p.id AND m.page <= p.page WHERE p.text <> '' GROUP BY ALL),
by_mark AS (SELECT id, page, 0 AS part, nullif(concat_ws(' › ', a[2], CASE WHEN a IS NULL OR b[1] > a[1] THEN b[2] END, CASE WHEN (a IS NULL OR c[1] > a[1]) AND (b IS NULL OR c[1] > b[1]) THEN c[2] END), '') AS section, text AS t FROM lasts),
toc AS (SELECT id, page, 0 AS part, 'Contents' AS section, text AS t FROM np WHERE id NOT IN (FROM marked) AND len(regexp_extract_all(text, '\.{4}')) >= 5),
src AS (SELECT id, page, string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) AS lines FROM np WHERE text <> '' AND id NOT IN (FROM marked) AND len(regexp_extract_all(text, '\.{4}')) < 5),
l0 AS (SELECT id, page, unnest(lines) AS raw, generate_subscripts(lines, 1) - 1 AS n, len(lines) AS n_lines FROM src),
l1 AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line, coalesce(regexp_replace(lead(raw) OVER (PARTITION BY id, page ORDER BY n), '^\s+|\s+$', '', 'g'), '') AS title FROM l0),
l2 AS (SELECT *, NOT contains(line, '....') AND right(line, 1) NOT IN ('.', ':', ',', ';') AS usable, regexp_matches(line, '^([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})\s+([A-Za-z][^\n]{1,80})$') AND len(string_split_regex(regexp_extract(line, '^([0-9.]+)\s+(.*)$', 2), '\s+')) <= 8 AS one,
  regexp_matches(line, '^[0-9]{1,2}(?:\.[0-9]{1,2}){1,3}$') AND regexp_matches(title, '^[A-Za-z][\p{L}\p{N}_ &/,\-–()''’]{1,80}$') AND NOT contains(title, '....') AND right(title, 1) NOT IN ('.', ':') AS two FROM l1),
l3 AS (SELECT *, CASE WHEN usable AND one THEN regexp_extract(line, '^([0-9.]+)', 1) WHEN usable AND two THEN line END AS num, CASE WHEN one THEN 1 ELSE 2 END AS used,
  CASE WHEN one THEN trim(regexp_extract(line, '^([0-9.]+)\s+(.*)$', 2)) ELSE title END AS name FROM l2),
l4 AS (SELECT *, CASE WHEN num IS NOT NULL AND string_split(num, '.')[1]::INT BETWEEN 1 AND 40 THEN list_transform(string_split(num, '.'), lambda x: x::INT) END AS number FROM l3),
l5 AS (SELECT *, coalesce(number > max(number) OVER (PARTITION BY id ORDER BY page, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), number IS NOT NULL) AND number IS NOT NULL AS accepted FROM l4),
l6 AS (SELECT *, CASE WHEN accepted THEN concat(num, ' ', name) END AS label, sum(accepted::INT) OVER (PARTITION BY id ORDER BY page, n) AS nth FROM l5),
heads AS (SELECT id, nth, len(number) AS depth, label FROM l6 WHERE accepted),
paths AS (SELECT h.id, h.nth, string_agg(g.label, ' › ' ORDER BY g.nth) AS section FROM heads h JOIN heads g ON g.id = h.id AND g.nth <= h.nth
  WHERE NOT EXISTS (SELECT 1 FROM heads k WHERE k.id = h.id AND k.nth > g.nth AND k.nth <= h.nth AND k.depth <= g.depth) GROUP BY h.id, h.nth),
kept AS (SELECT *, accepted OR NOT coalesce(lag(accepted) OVER w AND lag(used) OVER w = 2, false) AS stays FROM l6 WINDOW w AS (PARTITION BY id, page ORDER BY n)),
cut AS (SELECT id, page, nth, regexp_replace(string_agg(CASE WHEN accepted THEN label ELSE raw END, chr(10) ORDER BY n), '^\s+|\s+$', '', 'g') AS t FROM kept WHERE stays GROUP BY id, page, nth),
by_number AS (SELECT c.id, c.page, c.nth AS part, p.section, c.t FROM cut c LEFT JOIN paths p ON p.id = c.id AND p.nth = c.nth WHERE c.t <> ''),
every AS (FROM by_mark UNION ALL FROM toc UNION ALL FROM by_number)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY page, part) - 1)::INT AS place, page, section, md5(t) AS h FROM every
"""


def chunked(d: DataFrame) -> DataFrame:
    """Documents as files of line windows, chunked."""
    windows = text_windows(d.select(F.col("id").alias("file_id"), F.concat("lang", F.lit(".txt")).alias("file_name"), "text"))
    segments = windows.withColumn("place", F.col("line_start")).withColumn("loc_type", F.lit("lines")).withColumn("page", F.lit(None).cast("int")).withColumn("heading", F.lit(None).cast("string"))
    made = C.file_chunks(segments, "multilingual-e5-small")
    return made.select("file_id", "ordinal", "place", "label", "header", "tokens", F.md5(F.col("text").cast("binary")).alias("h"))


STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"
TOKENS = "greatest(1, round_even(len(" + WORDS + ") * 1.3::DOUBLE, 0)::INT)"
BROKEN = "string_split(regexp_replace(p, '([.!?])\\s+([A-Z0-9\"''(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
CHUNKS_SQL = f"""
WITH RECURSIVE ln AS (SELECT id, lang, unnest(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)), 1) AS n FROM documents WHERE text <> ''),
seg AS (SELECT id, any_value(lang) AS lang, (n - 1) // 60 * 60 + 1 AS a, max(n) AS b, {STRIP.format("string_agg(line, chr(10) ORDER BY n)")} AS s FROM ln GROUP BY id, (n - 1) // 60),
par AS (SELECT id, a, unnest(string_split_regex(s, '\\n\\s*\\n')) AS p, generate_subscripts(string_split_regex(s, '\\n\\s*\\n'), 1) AS k FROM seg WHERE s <> ''),
un AS (SELECT id, a, k, unnest(u) AS u, generate_subscripts(u, 1) AS m FROM (SELECT id, a, k, CASE WHEN len(p) > 600 THEN {BROKEN} ELSE [p] END AS u FROM (SELECT id, a, k, {STRIP.format("p")} AS p FROM par) WHERE p <> '')),
sized AS (SELECT id, a, k, m, {STRIP.format("u")} AS u, {TOKENS.format("u")} AS n FROM un WHERE {STRIP.format("u")} <> ''),
cutw AS (SELECT id, a, k, m, u, n, {WORDS.format("u")} AS w, greatest(1, floor(len({WORDS.format("u")}) * 448 / n::DOUBLE * 0.9::DOUBLE)::INT) AS step FROM sized),
piece AS (SELECT id, a, k, m, 0 AS q, u FROM cutw WHERE n <= 448 UNION ALL SELECT id, a, k, m, q, array_to_string(list_slice(w, q + 1, q + step), ' ') FROM (SELECT *, unnest(range(0, len(w), step)) AS q FROM cutw WHERE n > 448)),
units AS (SELECT id, a, list(u ORDER BY k, m, q) AS u, list({TOKENS.format("u")} ORDER BY k, m, q) AS n FROM piece GROUP BY id, a),
sums AS (SELECT id, a, u, n, list_transform(range(0, len(n) + 1), lambda i: coalesce(list_sum(list_slice(n, 1, i)), 0)::INT) AS p FROM units),
ends AS (
  SELECT id, a, 0 AS first, 0 AS nth FROM sums UNION ALL
  SELECT e.id, e.a, CASE WHEN e.last = len(s.n) THEN len(s.n) WHEN s.p[e.last + 2] - s.p[e.carried + 1] > 448 THEN e.last ELSE e.carried END, e.nth + 1
  FROM (SELECT e.*, greatest(first + 1, len(list_filter(s.p, lambda x: x <= s.p[e.first + 1] + 448)) - 1) AS last, greatest(first, len(list_filter(s.p, lambda x: x < s.p[greatest(first + 1, len(list_filter(s.p, lambda x: x <= s.p[e.first + 1] + 448)) - 1) + 1] - 50))) AS carried
    FROM ends e JOIN sums s ON s.id = e.id AND s.a = e.a WHERE first < len(s.n)) e JOIN sums s ON s.id = e.id AND s.a = e.a),
made AS (SELECT e.id, e.a, nth, s.p[last + 1] - s.p[first + 1] AS tokens, array_to_string(list_slice(s.u, first + 1, last), chr(10) || chr(10)) AS t
  FROM (SELECT e.*, greatest(first + 1, len(list_filter(s.p, lambda x: x <= s.p[e.first + 1] + 448)) - 1) AS last FROM ends e JOIN sums s ON s.id = e.id AND s.a = e.a WHERE first < len(s.n)) e JOIN sums s ON s.id = e.id AND s.a = e.a),
kept AS (SELECT * FROM made WHERE len(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) >= 3)
SELECT k.id AS file_id, (row_number() OVER (PARTITION BY k.id ORDER BY k.a, nth) - 1)::INT AS ordinal, k.a AS place, concat('Lines ', k.a, '–', g.b) AS label, concat('[Source: ', lang, '.txt | Lines ', k.a, '–', g.b, ']') AS header, tokens, md5(t) AS h
FROM kept k JOIN seg g ON g.id = k.id AND g.a = k.a
"""


def code_answers(m: DataFrame) -> DataFrame:
    """Sources as samples of code, answers with a block of their own and one of the first source."""
    code = lambda s: F.concat(F.lit("Intro line\nStep 1\n"), F.replace(s, F.lit(" "), F.lit(" = f(x)\n")), F.lit("\nNotes\nend"))
    rows = with_sources(m, but_question=True).withColumn("codes", F.transform("sources", code))
    block = F.concat(F.lit("Text\n```\n"), F.col("answer"), F.lit("\n```\nand\n```\n"), F.coalesce(F.get("codes", F.lit(0)), F.lit("")), F.lit("\n```\n"))
    return rows.select("conv_id", "turn", block.alias("answer"), "question", F.col("codes").alias("sources"), F.map_from_arrays(F.array(F.lit(1)), F.array(F.lit(2))).alias("after"))


CODES = """
codes AS (SELECT conv_id, turn, question, list_transform(sources, lambda s: concat('Intro line', chr(10), 'Step 1', chr(10), replace(s, ' ', ' = f(x)' || chr(10)), chr(10), 'Notes', chr(10), 'end')) AS sources, answer FROM answers),
"""
IDENTIFIERS = "list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda x: lower(x)))"


def ready(o: DataFrame, seconds: int = 3600) -> DataFrame:
    """For every sight of a file, whether it may be read: unchanged for so long, or forced."""
    order = Window.partitionBy("file_id").orderBy("seen_at", "id")
    state = F.struct("size_bytes", "mtime")
    runs = o.withColumn("new", F.when(F.lag(state).over(order).eqNullSafe(state), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    since = F.min("seen_at").over(Window.partitionBy("file_id", "run"))
    return runs.select("id", (F.col("forced") | (F.col("seen_at") - F.make_dt_interval(secs=F.lit(seconds)) >= since)).alias("ready"))


QUERIES: dict[str, Query] = {
    "citation_markers": Query(
        ("messages",),
        lambda m: with_sources(m).withColumn("all", A.markers(F.col("answer"))).select("conv_id", "turn", F.array_join(F.array_distinct(F.filter("all", lambda x: (x >= 1) & (x <= F.size("sources")))), ",").alias("cited"), F.array_join(F.filter("all", lambda x: (x < 1) | (x > F.size("sources"))), ",").alias("invalid")),
        f"WITH {ANSWERS}, n AS (SELECT *, flatten({NUMBERS}) AS l FROM answers), v AS (SELECT *, list_filter(l, lambda x: x >= 1 AND x <= len(sources)) AS good FROM n) SELECT conv_id, turn, coalesce(array_to_string(list_filter(good, lambda x, i: list_position(good, x) = i), ','), '') AS cited, coalesce(array_to_string(list_filter(l, lambda x: x < 1 OR x > len(sources)), ','), '') AS invalid FROM v",
    ),
    "sentence_grounding": Query(("messages",), grounded, f"WITH {ANSWERS}, {SENTENCES} SELECT conv_id, turn, place, source, score FROM (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY ln, sn) - 1)::INT AS place, n AS source, round(best, 9) AS score FROM graded) WHERE score >= 0.5"),
    "answer_support": Query(
        ("messages",),
        lambda m: A.support(with_sources(m)).select("conv_id", "turn", F.round("supported", 9).alias("supported"), "hedged"),
        f"WITH {ANSWERS}, {SENTENCES}, t AS (SELECT conv_id, turn, sum(len(words)) AS total, sum(CASE WHEN best >= 0.5 THEN len(words) ELSE 0 END) AS backed FROM graded GROUP BY ALL) SELECT a.conv_id, a.turn, round(coalesce(backed / total::DOUBLE, 1.0), 9) AS supported, regexp_matches(answer, '(?i){HEDGE.replace(chr(39), chr(39) * 2)}') AS hedged FROM answers a LEFT JOIN t ON t.conv_id = a.conv_id AND t.turn = a.turn",
    ),
    "off_topic_terms": Query(
        ("messages",),
        lambda m: with_sources(m, but_question=True).select("conv_id", "turn", F.array_join(A.off_topic(F.col("question"), F.col("answer"), F.col("sources")), ",").alias("terms")),
        f"WITH {answers_sql(but_question=True)}, {SENTENCES}, w AS (SELECT conv_id, turn, list_distinct(flatten(list(words))) AS words FROM s2 GROUP BY ALL) SELECT a.conv_id, a.turn, coalesce(array_to_string(list_sort(list_filter(list_intersect({terms('question', 4, ASKING)}, w.words), lambda t: NOT list_contains(flatten(list_transform(a.sources, lambda x: {terms('x')})), t))), ','), '') AS terms FROM answers a JOIN w ON w.conv_id = a.conv_id AND w.turn = a.turn",
    ),
    "not_found_answers": Query(("messages",), lambda m: m.select("conv_id", "turn", T.is_not_found(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("I  could not find anything about this in the selected\ndocument folders. "), "content")).otherwise(F.col("content"))).alias("not_found")), f"SELECT conv_id, turn, turn % 2 = 0 AND len(trim(regexp_replace(concat('I  could not find anything about this in the selected', chr(10), 'document folders. ', content), '\\s+', ' ', 'g'))) < {len(NOT_FOUND)} + 200 AS not_found FROM messages"),
    "marker_texts": Query(("messages",), lambda m: with_sources(m).select("conv_id", "turn", F.md5(tidied(F.col("answer"), F.size("sources")).cast("binary")).alias("h")), f"WITH {answers_sql('given')}, {TIDIED} SELECT conv_id, turn, md5(answer) AS h FROM answers"),
    "best_code_source": Query(
        ("messages",),
        lambda m: code_answers(m).select("conv_id", "turn", F.coalesce(likeliest(T.identifiers(F.col("question")), F.col("sources")), F.lit(0)).alias("place")),
        f"""WITH {answers_sql(but_question=True)}, {CODES} scored AS (SELECT *, list_transform(sources, lambda s, k: struct_pack(n := len(list_filter(string_split(s, chr(10)), lambda l: regexp_matches(l, '[=(){{}}\\[\\];]') OR regexp_matches(l, '(?i)^\\s*(IF|ELSE|END|FOR|RETURN|Step \\d)\\b'))),
        same := len(list_intersect({IDENTIFIERS.format('question')}, {IDENTIFIERS.format('s')})), k := k)) AS facts FROM codes) SELECT conv_id, turn, coalesce(list_max(list_transform(list_filter(facts, lambda f: f.n >= 3), lambda f: (30 + f.same + 2 * least(f.n, 10) - (f.k - 1), f.k)))[2], 0)::INT AS place FROM scored""",
    ),
    "code_guard": Query(
        ("messages",),
        lambda m: code_answers(m).withColumn("g", guarded(F.col("answer"), F.col("sources"), F.col("question"), F.col("after"))).select("conv_id", "turn", F.col("g.changes").alias("changes"), F.md5(F.col("g.text").cast("binary")).alias("h")),
        f"""WITH {answers_sql(but_question=True)}, {CODES} scored AS (SELECT *, list_transform(sources, lambda s, k: struct_pack(n := len(list_filter(string_split(s, chr(10)), lambda l: regexp_matches(l, '[=(){{}}\\[\\];]') OR regexp_matches(l, '(?i)^\\s*(IF|ELSE|END|FOR|RETURN|Step \\d)\\b'))),
        same := len(list_intersect(list_distinct(list_concat({IDENTIFIERS.format('question')}, {IDENTIFIERS.format('answer')})), {IDENTIFIERS.format('s')})), k := k)) AS facts FROM codes),
        best AS (SELECT *, list_max(list_transform(list_filter(facts, lambda f: f.n >= 3), lambda f: (30 + f.same + 2 * least(f.n, 10) - (f.k - 1), f.k)))[2] AS p FROM scored),
        cut AS (SELECT *, list_slice(list_filter(list_transform(string_split(regexp_extract(sources[p], '(?s)(Step 1.*)\\nNotes', 1), chr(10)), lambda l: regexp_replace(l, '\\s+$', '')), lambda l: l <> ''), 1, 80) AS lines FROM best)
        SELECT conv_id, turn, 1 AS changes, md5(concat('Text', chr(10), CASE WHEN p IS NULL THEN '_The documents don''t include a code sample for this._' ELSE concat('The documents show this sample [', p, ']:', chr(10), chr(10), '```text', chr(10), array_to_string(lines, chr(10)), chr(10), '```') END,
        chr(10), 'and', chr(10), '```', chr(10), coalesce(sources[1], ''), chr(10), '```', chr(10))) AS h FROM cut""",
    ),
    "verbatim_code": Query(
        ("messages",),
        lambda m: with_sources(m).select("conv_id", "turn", A.verbatim(F.element_at("sources", 1), F.slice("sources", 1, 1)).alias("own"), A.verbatim(F.col("answer"), F.col("sources")).alias("verbatim"), T.code_lines(F.col("answer")).alias("n_code")),
        f"WITH {ANSWERS} SELECT conv_id, turn, true AS own, len(list_filter(string_split(answer, chr(10)), lambda l: trim(regexp_replace(regexp_replace(l, '\\[[0-9]+\\]', '', 'g'), '\\s+', ' ', 'g')) <> '' AND NOT contains(trim(regexp_replace(regexp_replace(array_to_string(sources, chr(10)), '\\[[0-9]+\\]', '', 'g'), '\\s+', ' ', 'g')), trim(regexp_replace(regexp_replace(l, '\\[[0-9]+\\]', '', 'g'), '\\s+', ' ', 'g'))))) = 0 AS verbatim, len(list_filter(string_split(answer, chr(10)), lambda l: regexp_matches(l, '[=(){{}}\\[\\];]') OR regexp_matches(l, '(?i)^\\s*(IF|ELSE|END|FOR|RETURN|Step \\d)\\b'))) AS n_code FROM answers",
    ),
    "visible_sources": Query(
        ("citations",),
        lambda c: c.groupBy("message_id").agg(F.array_join(F.array_sort(F.collect_list(F.when((F.col("message_id") % 3 == 0) | (F.col("file_id") % 2 == 0), F.col("marker")))), ",").alias("shown")).select("message_id", F.when(F.col("message_id") % 3 == 1, "").otherwise(F.col("shown")).alias("shown")),
        "SELECT message_id, CASE WHEN message_id % 3 = 1 THEN '' ELSE coalesce(string_agg(marker::VARCHAR, ',' ORDER BY marker) FILTER (message_id % 3 = 0 OR file_id % 2 = 0), '') END AS shown FROM citations GROUP BY message_id",
    ),
    "stability_gate": Query(
        ("observations",),
        ready,
        """WITH r AS (SELECT *, CASE WHEN lag(size_bytes) OVER w IS NOT DISTINCT FROM size_bytes AND lag(mtime) OVER w IS NOT DISTINCT FROM mtime THEN 0 ELSE 1 END AS new FROM observations WINDOW w AS (PARTITION BY file_id ORDER BY seen_at, id)),
        u AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY seen_at, id) AS run FROM r) SELECT id, forced OR seen_at - INTERVAL 3600 SECONDS >= min(seen_at) OVER (PARTITION BY file_id, run) AS ready FROM u""",
    ),
    "watch_debounce": Query(
        ("heartbeats",),
        lambda h: watch.scans(h.withColumnRenamed("user_id", "folder_id"), gap=3_600),
        """WITH g AS (SELECT *, CASE WHEN seen_at - lag(seen_at) OVER (PARTITION BY user_id ORDER BY seen_at) < INTERVAL 3600 SECONDS THEN 0 ELSE 1 END AS new FROM heartbeats),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY seen_at) AS k FROM g) SELECT user_id AS folder_id, max(seen_at) + INTERVAL 3600 SECONDS AS due_at, count(*) AS n_events FROM s GROUP BY user_id, k""",
    ),
    "checked_answers": Query(
        ("messages",),
        lambda m: A.checked(with_sources(m, but_question=True), ["conv_id", "turn"]).select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("h"), F.array_join("cited", ",").alias("cited"), F.array_join("invalid", ",").alias("invalid"), "not_found", "regrounded", F.round("supported", 9).alias("supported"), "code_changes"),
        f"""WITH {answers_sql('given', but_question=True)}, {TIDIED}, {SENTENCES}, {GROUNDED},
        t AS (SELECT conv_id, turn, sum(len(words)) AS total, sum(CASE WHEN best >= 0.5 THEN len(words) ELSE 0 END) AS backed FROM graded GROUP BY ALL),
        w AS (SELECT conv_id, turn, list_distinct(flatten(list(words))) AS words FROM s2 GROUP BY ALL),
        j AS (SELECT a.*, len(sources) = 0 AS bare, coalesce(backed / total::DOUBLE, 1.0) AS support, regexp_matches(answer, '(?i){HEDGE.replace(chr(39), chr(39) * 2)}') AS hedged,
          len(list_filter(list_intersect({terms('question', 4, ASKING)}, w.words), lambda x: NOT list_contains(flatten(list_transform(a.sources, lambda x: {terms('x')})), x))) > 0 AS strays, f.text, f.changes
          FROM answers a LEFT JOIN t ON t.conv_id = a.conv_id AND t.turn = a.turn LEFT JOIN w ON w.conv_id = a.conv_id AND w.turn = a.turn LEFT JOIN final f ON f.conv_id = a.conv_id AND f.turn = a.turn),
        v AS (SELECT *, NOT bare AND (hedged OR support < 0.5 OR strays) AS replaced FROM j),
        r AS (SELECT *, CASE WHEN replaced THEN '{NOT_FOUND}' WHEN bare THEN answer ELSE text END AS out FROM v),
        c AS (SELECT *, list_transform(regexp_extract_all(out, '\\[([0-9]+)\\]', 1), lambda x: x::INT) AS l, flatten({NUMBERS.replace('(answer,', '(raw,')}) AS every FROM r)
        SELECT conv_id, turn, md5(out) AS h, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ','), '') AS cited, coalesce(array_to_string(list_filter(every, lambda x: x < 1 OR x > len(sources)), ','), '') AS invalid,
        replaced AS not_found, CASE WHEN replaced OR bare THEN 0 ELSE changes END AS regrounded, CASE WHEN bare THEN 1.0 ELSE round(support, 9) END AS supported, 0 AS code_changes FROM c""",
    ),
    "chunks": Query(("documents",), chunked, CHUNKS_SQL),
    "numbered_sections": Query(("pages",), sections, SECTIONS_SQL),
}
