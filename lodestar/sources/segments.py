"""Segments of texts: line windows, Markdown sections, paragraph units. All are made inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.constants import LINES_PER_SEGMENT, LONG_PARAGRAPH
from lodestar.functions.text import trimmed

#: What ends a line: all of Python's splitlines, as one class.
LINE_ENDS = r"\r\n|[\r\x0B\x0C\x1C-\x1E\x85  ]"
HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])"


def lines_of(text: Column) -> Column:
    """The lines of a text; an end at the very end begins no further line."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), LINE_ENDS, "\n"), "\n$", "")
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, "\n"))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def text_windows(files: DataFrame, text_col: str = "text", size: int = LINES_PER_SEGMENT) -> DataFrame:
    """Windows of so many lines with their line range; blank windows are left out. Other columns are kept."""

    def cut(lines: Column) -> Column:
        starts = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
        window = lambda s: F.struct(trimmed(F.array_join(F.slice(lines, s + 1, F.lit(size)), "\n")).alias("segment"), (s + 1).alias("line_start"), F.least(s + size, F.size(lines)).alias("line_end"))
        return F.filter(F.transform(starts, window), lambda w: w["segment"] != "")

    return files.select(*[c for c in files.columns if c != text_col], F.explode(_let(lines_of(F.col(text_col)), cut)).alias("w")).select("*", "w.*").drop("w")


def is_heading(line: Column) -> Column:
    return line.startswith("#") & F.regexp_like(line, F.lit(HEADING))


def markdown_sections(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Sections by headings, with the heading line in the text; what stands before the first heading is plain lines."""

    def cut(lines: Column) -> Column:
        marks = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: is_heading(F.element_at(lines, i)))
        starts = F.array_distinct(F.concat(F.array(F.lit(1)), marks))
        spans = F.zip_with(starts, F.slice(starts, F.lit(2), F.size(starts)), lambda a, b: F.struct(a.alias("a"), F.coalesce(b - 1, F.size(lines)).alias("b")))

        def section(s: Column) -> Column:
            first = F.element_at(lines, s["a"])
            heading = F.when(is_heading(first), F.regexp_extract(first, HEADING, 2))
            kind = F.when(F.length(heading) > 0, "heading").otherwise("lines")
            return F.struct(trimmed(F.array_join(F.slice(lines, s["a"], s["b"] - s["a"] + 1), "\n")).alias("segment"), kind.alias("loc_type"), heading.alias("heading"), s["a"].alias("line_start"), s["b"].alias("line_end"))

        return F.when(F.size(lines) > 0, F.filter(F.transform(spans, section), lambda x: x["segment"] != ""))

    return files.select(*[c for c in files.columns if c != text_col], F.explode(_let(lines_of(F.col(text_col)), cut)).alias("s")).select("*", "s.*").drop("s")


def paragraph_units(text: Column, long: int = LONG_PARAGRAPH) -> Column:
    """Paragraphs, long ones as sentences."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), trimmed), lambda p: p != "")
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > long, F.filter(F.transform(F.split(p, SENTENCE_END), trimmed), lambda s: s != "")).otherwise(F.array(p))))
