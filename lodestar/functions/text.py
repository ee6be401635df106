"""Scalar text functions as columns: labels, headers, snippets, titles, terms, estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.constants import CHARS_PER_TOKEN, MIN_LETTERS, NOT_FOUND, QUESTION_WORDS, SECTION_SEPARATOR, SNIPPET_CHARS, STOP_WORDS, TOC_DOTS

#: PostgreSQL's English stop words (fixed values).
ENGLISH_STOP = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)


def search_text(text: Column) -> Column:
    """The text with camel case taken apart; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")


def squeezed(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def section_title(section: Column) -> Column:
    """A section path without its numbers, camel case taken apart."""
    parts = F.transform(F.split(section, SECTION_SEPARATOR), lambda p: F.regexp_replace(p, r"^[0-9]+(\.[0-9]+)*\s+", ""))
    return search_text(F.array_join(parts, SECTION_SEPARATOR))


def timestamp_label(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour; null is 0:00."""
    s = F.coalesce(seconds, F.lit(0)).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))


def location_label(kind: Column, *, page=None, first=None, last=None, heading=None, sheet=None, row_first=None, row_last=None, t_first=None, t_last=None) -> Column:
    """Where a passage is, for people. Without a better location it is a range of lines."""
    none = F.lit(None).cast("string")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None")) if c is not None else none
    span = lambda a, b: F.concat(text(a), F.lit("–"), text(b))
    lines = F.concat(F.lit("Lines "), span(first, last)) if first is not None else none
    out = lines
    if heading is not None:
        titled = F.concat(F.lit("Section “"), heading, F.lit("”, lines "), span(first, last))
        out = F.when((kind == "heading") & (F.length(heading) > 0), titled).otherwise(out)
    if sheet is not None:
        out = F.when(kind == "sheet_rows", F.concat(F.lit("Sheet "), text(sheet), F.lit(", rows "), span(row_first, row_last))).otherwise(out)
    if t_first is not None:
        out = F.when(kind == "time", F.concat(timestamp_label(t_first), F.lit("–"), timestamp_label(t_last))).otherwise(out)
    if page is not None:
        out = F.when(kind == "page", F.concat(F.lit("Page "), text(page))).when(kind == "slide", F.concat(F.lit("Slide "), text(page))).otherwise(out)
    return out


def section_of(kind: Column, heading: Column) -> Column:
    """The section path shown beside pages and slides."""
    return F.when(kind.isin("page", "slide") & (F.length(heading) > 0), heading)


def source_header(file_name: Column, label: Column, section: Column | None = None) -> Column:
    more = F.lit("") if section is None else F.when(F.length(section) > 0, F.concat(F.lit(" | "), section)).otherwise("")
    return F.concat(F.lit("[Source: "), file_name, F.lit(" | "), label, more, F.lit("]"))


def snippet(text: Column, most: int = SNIPPET_CHARS) -> Column:
    """The beginning of a passage, cut at a space, with an ellipsis if it goes on."""
    t = squeezed(F.regexp_replace(text, r"\[Screenshot text\]\s*", ""))
    head = F.substring(t, 1, most)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("…")))


def open_url(file_id: Column, kind: Column, page: Column) -> Column:
    paged = F.when(page > 0, F.concat(F.lit("#page="), page.cast("string"))).otherwise("")
    return F.concat(F.lit("/api/files/"), file_id.cast("string"), F.when(kind.isin("pdf", "office"), F.concat(F.lit("/pdf"), paged)).otherwise("/content"))


def estimated_tokens(text: Column) -> Column:
    """Prompt tokens by length."""
    return (F.floor(F.length(text) / CHARS_PER_TOKEN) + 1).cast("long")


def words_of(text: Column) -> Column:
    """White-space separated words."""
    t = squeezed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def fallback_tokens(text: Column) -> Column:
    """Tokens by words, 1.3 for each, rounded half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(F.size(words_of(text)) * 1.3, 0).cast("long"))


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def terms(text: Column) -> Column:
    """Distinct content words by their first five characters."""
    kept = F.filter(tokens_of(text), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))
    return F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, 5)))


def topic_terms(question: Column) -> Column:
    """A question's own topic: longer words that neither are common nor frame questions."""
    kept = F.filter(tokens_of(question), lambda w: (F.length(w) >= 4) & ~w.isin(*STOP_WORDS) & ~w.isin(*QUESTION_WORDS))
    return F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, 5)))


def lexemes(text: Column) -> Column:
    """Search tokens in order: letters and digits of any script, without English stop words, not stemmed."""
    return F.filter(F.regexp_extract_all(F.lower(search_text(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: ~w.isin(*ENGLISH_STOP))


def is_not_found(answer: Column) -> Column:
    """Whether an answer is no more than the not-found sentence."""
    a = F.lower(squeezed(F.translate(answer, "’", "'")))
    return F.contains(a, F.lit(NOT_FOUND.lower().rstrip("."))) & (F.length(a) < len(NOT_FOUND) + 200)


def normal_code(text: Column) -> Column:
    """Code for comparison: plain quotes and dashes, no markers, single spaces."""
    return squeezed(F.regexp_replace(F.translate(text, "“”‘’–—", "\"\"''--"), r"\[[0-9]+\]", ""))


def identifiers(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)), F.lower))


def code_lines(text: Column) -> Column:
    """How many lines look like code."""
    return F.size(F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"(?i)[=(){}\[\];]|^\s*(IF|ELSE|END|FOR|RETURN|Step \d)\b"))))


def has_content(text: Column, heading: Column | None = None) -> Column:
    """False for passages with fewer than three letters, and for those that are only their section's title."""
    enough = F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= MIN_LETTERS
    if heading is None:
        return enough
    title = F.lower(squeezed(F.element_at(F.split(F.coalesce(heading, F.lit("")), SECTION_SEPARATOR), -1)))
    return enough & ((title == "") | (F.lower(squeezed(text)) != title))


def is_contents_page(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\.{4}")) >= TOC_DOTS


DEFINITIONAL = (
    r"(?i)^\s*(what\s+(is|are)\b|what's\b|tell\s+me\s+about\b|describe\b|explain\b|(give\s+(me\s+)?)?an?\s+(overview|summary|introduction)\b"
    r"|(overview|summary|introduction)\s+of\b|what\s+does\s+.+\s+(do|cover|offer|provide)\b)"
)
NOT_DEFINITIONAL = r"(?i)\b(code|sample|example|snippet|steps?|how|parameters?|error|response)\b"
OVERVIEW = r"(?i)\b(overview|introduction|summary|purpose|background|about)\b"


def is_definitional(question: Column) -> Column:
    """Questions that an overview answers."""
    return F.regexp_like(question, F.lit(DEFINITIONAL)) & ~F.regexp_like(question, F.lit(NOT_DEFINITIONAL)) & (F.size(words_of(question)) <= 10)


def is_overview(heading: Column) -> Column:
    return F.coalesce(F.regexp_like(heading, F.lit(OVERVIEW)), F.lit(False))


def linked_markers(text: Column) -> Column:
    """Citation markers as links."""
    return F.regexp_replace(text, r"\[([0-9]+)\]", "[$1](#cite-$1)")


def without_thoughts(text: Column) -> Column:
    """A model's output without its thinking."""
    return trimmed(F.regexp_replace(text, r"(?s)<think>.*?(</think>|$)", ""))
