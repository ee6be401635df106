"""Generated answers as columns: citation markers, sentences, which source a sentence comes from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.constants import MIN_BEST, MIN_WORDS, REASSIGN_RATIO
from lodestar.functions.arrays import let
from lodestar.functions.text import is_not_found, terms, trimmed

# Patterns that decide what counts as a marker, an admission, an own line.
MARKER = r"\[(?:sources?\s*:?\s*)?(\d+(?:\s*,\s*\d+)*)\]"
HEDGE = (
    r"\b(?:(?:the\s+)?(?:provided\s+|given\s+)?(?:documents?|sources?|context|texts?)\s+(?:do(?:es)?\s*n[o']t|do(?:es)?\s+not)\s+"
    r"(?:contain|mention|provide|include|specify|cover|describe|explain|say)|not\s+(?:mentioned|provided|covered|specified|described)\s+in\s+"
    r"the\s+(?:documents?|sources?|context)|(?:based\s+on|from)\s+(?:general|common)\s+knowledge|generally\s+speaking|in\s+general,)"
)
OWN_LINE = r"^\s*_?(?:The documents show this sample|The documents define the method|The documents don't include a code sample|See the sample from the documents)"
BULLET = r"^\s*(?:[-*+]|\d+[.)])?\s*"
SENTENCE_BREAK = r"(?<=[.!?])\s+"

NUMBER = r"\[([0-9]+)\]"
ANY_MARKER = "(?i)" + MARKER
CODE = r"(?s)```.*?(?:```|\z)"
#: Whole lines from a fence to the next one, or to the end.
CODE_LINES = r"(?dms)^[^\S\n]*```[^\n]*(?:\n.*?^[^\S\n]*```[^\n]*|.*\z)"
BIGGEST = 2**31 - 1


def number(digits: Column) -> Column:
    return F.coalesce(digits.try_cast("int"), F.lit(BIGGEST))


def replace_each(text: Column, pattern: str, made: Callable[[Column], Column], kept: Callable[[Column], Column] | None = None) -> Column:
    """The text with made(match) for every match of the pattern, and kept(stretch) for what lies between matches."""
    between = F.split(text, pattern, -1)
    if kept is not None:
        between = F.transform(between, kept)
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), made)
    return F.array_join(F.zip_with(between, matches, lambda b, m: F.concat(b, F.coalesce(m, F.lit("")))), "")


def marker_numbers(marker: Column) -> Column:
    return F.transform(F.regexp_extract_all(marker, F.lit("[0-9]+"), F.lit(0)), number)


def markers(answer: Column) -> Column:
    """All numbers of all markers, in order."""
    return F.flatten(F.transform(F.regexp_extract_all(answer, F.lit(ANY_MARKER), F.lit(0)), marker_numbers))


def plain(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))), "")


def tidied(answer: Column, n_sources: Column) -> Column:
    """Every marker as single numbers, each once, without those that no source has; and no gaps where one was."""
    text = replace_each(answer, ANY_MARKER, lambda m: plain(F.array_distinct(F.filter(marker_numbers(m), lambda x: x.between(1, n_sources)))))
    return trimmed(F.regexp_replace(F.regexp_replace(text, r"[ \t]+(?=[.,;:])", ""), r"(?<=\S)[ \t]{2,}", " "))


def cited(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), number))


def unmarked(sentence: Column) -> Column:
    return F.regexp_replace(sentence, NUMBER, "")


def is_own_line(line: Column) -> Column:
    return F.regexp_like(line, F.lit("(?i)" + OWN_LINE))


def sentences(answer: Column) -> Column:
    """Prose sentences: no code, no lines of the library's own, no list marks."""
    lines = F.filter(F.split(F.regexp_replace(answer, CODE, "\n"), "\n"), lambda x: ~is_own_line(x))
    parts = F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, BULLET, ""), SENTENCE_BREAK)))
    return F.filter(parts, lambda s: F.regexp_like(s, F.lit(r"\S")))


def is_hedged(answer: Column) -> Column:
    return F.exists(sentences(answer), lambda s: F.regexp_like(s, F.lit("(?i)" + HEDGE)))


def shares(words: Column, known: Column) -> Column:
    """The share of the words that each source has."""
    return F.transform(known, lambda s: F.size(F.array_intersect(words, s)) / F.size(words))


def regrounded(sentence: Column, known: Column) -> Column:
    """(text, changes): the sentence cites what it comes from, if that is clear.

    A source that has much less of the sentence than the best one has gives its marker to that; without any marker the
    sentence gets the best one's. Clear is a best share of a half or more, in a sentence of three content words or more.
    """

    def with_shares(share: Column) -> Column:
        top = F.array_max(share)
        best = F.array_position(share, top).cast("int")
        old = F.transform(F.regexp_extract_all(sentence, F.lit(NUMBER), F.lit(1)), number)
        moved = F.array_distinct(F.transform(old, lambda x: F.when(F.get(share, x - 1) < REASSIGN_RATIO * top, best).otherwise(x)))
        new = F.when(F.size(moved) > 0, moved).otherwise(F.array(best))
        bare = F.regexp_replace(F.regexp_replace(sentence, r"\s*(?:\[[0-9]+\])+", ""), r"\s+\z", "")

        def written(b: Column) -> Column:
            end = F.regexp_extract(b, r"[.!?:;]*\z", 0)
            return F.concat(F.left(b, F.length(b) - F.length(end)), F.lit(" "), plain(new), end)

        rewritten = F.struct(let(bare, written).alias("text"), F.greatest(F.size(F.filter(old, lambda x: ~F.array_contains(new, x))), F.lit(1)).alias("changes"))
        return F.when((top >= MIN_BEST) & (new != old), rewritten).otherwise(F.struct(sentence.alias("text"), F.lit(0).alias("changes")))

    def with_words(words: Column) -> Column:
        enough = (F.size(words) >= MIN_WORDS) & ~is_not_found(unmarked(sentence))
        return F.when(enough, let(shares(words, known), with_shares)).otherwise(F.struct(sentence.alias("text"), F.lit(0).alias("changes")))

    return let(terms(unmarked(sentence)), with_words)


def grounded(text: Column, known: Column) -> Column:
    """(text, changes): markers before the full stop and out of code, then every prose sentence regrounded."""
    bare_code = replace_each(text, CODE, lambda block: F.regexp_replace(block, r"[ \t]*\[[0-9]+\]", ""))
    before_stop = F.regexp_replace(bare_code, r"([.!?])[ \t]*(\[[0-9]+\](?:[ \t]*\[[0-9]+\])*)[ \t]*", " $2$1")

    def line(x: Column) -> Column:
        def after(mark: Column) -> Column:
            parts = F.transform(F.split(F.substring(x, F.length(mark) + 1, F.length(x)), SENTENCE_BREAK), lambda s: regrounded(s, known))
            return let(parts, lambda p: F.struct(F.concat(mark, F.array_join(F.transform(p, lambda s: s["text"]), " ")).alias("text"), F.aggregate(p, F.lit(0), lambda n, s: n + s["changes"]).alias("changes")))

        untouched = is_own_line(x) | ~F.regexp_like(x, F.lit(r"\S"))
        return F.when(untouched, F.struct(x.alias("text"), F.lit(0).alias("changes"))).otherwise(let(F.regexp_extract(x, BULLET, 0), after))

    def with_parts(whole: Column) -> Column:
        prose = F.transform(F.split(whole, CODE_LINES, -1), lambda part: F.transform(F.split(part, "\n", -1), line))
        code = F.regexp_extract_all(whole, F.lit(CODE_LINES), F.lit(0))

        def joined(parts: Column) -> Column:
            texts = F.zip_with(parts, code, lambda p, c: F.concat(F.array_join(F.transform(p, lambda x: x["text"]), "\n"), F.coalesce(c, F.lit(""))))
            return F.struct(F.array_join(texts, "").alias("text"), F.aggregate(F.flatten(parts), F.lit(0), lambda n, x: n + x["changes"]).alias("changes"))

        return let(prose, joined)

    return let(before_stop, with_parts)
