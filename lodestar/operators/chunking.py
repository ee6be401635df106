"""Segments of files: numbered sections over pages, and chunks within segments.

Nothing here folds over text. Headings only go forward, so the last accepted heading is the largest number so far: whether
a heading is accepted, and which path it opens, are windows over a document's headings. Chunks are ranges of units, found
on the units' running sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.constants import CHUNK_TOKENS, MAX_HEADING_WORDS, MAX_TOP_SECTION, MODEL_MAX_TOKENS, MODEL_RESERVE, OVERLAP_TOKENS, SECTION_SEPARATOR
from lodestar.functions.arrays import let, running_sums
from lodestar.functions.text import fallback_tokens, has_content, is_contents_page, location_label, section_of, source_header, trimmed, words_of
from lodestar.sources.segments import lines_of, paragraph_units

# What a numbered heading looks like.
NUMBER_AND_TITLE = r"^([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})\s+([A-Za-z][^\n]{1,80})$"
NUMBER_ALONE = r"^[0-9]{1,2}(?:\.[0-9]{1,2}){1,3}$"
TITLE_ALONE = r"^[A-Za-z][\p{L}\p{N}_ &/,\-–()'’]{1,80}$"
DEPTHS = 4

HEADING = "array<struct<line:int,used:int,number:array<int>,label:string>>"


def headings(lines: Column) -> Column:
    """The lines that look like a numbered heading, on one line or with the title on the next: (line, used, number, label)."""
    clean = F.transform(lines, trimmed)

    def found(all_lines: Column) -> Column:
        def at(line: Column, i: Column) -> Column:
            title = F.coalesce(F.get(all_lines, i + 1), F.lit(""))
            usable = ~F.contains(line, F.lit("....")) & ~F.right(line, F.lit(1)).isin(".", ":", ",", ";")
            one = F.regexp_like(line, F.lit(NUMBER_AND_TITLE)) & (F.size(words_of(F.regexp_extract(line, NUMBER_AND_TITLE, 2))) <= MAX_HEADING_WORDS)
            two = F.regexp_like(line, F.lit(NUMBER_ALONE)) & F.regexp_like(title, F.lit(TITLE_ALONE)) & ~F.contains(title, F.lit("....")) & ~F.right(title, F.lit(1)).isin(".", ":")
            numbered = lambda number, used, text: F.struct(i.alias("line"), F.lit(used).alias("used"), F.transform(F.split(number, r"\."), lambda n: n.cast("int")).alias("number"), F.concat(number, F.lit(" "), text).alias("label"))
            return F.when(usable & one, numbered(F.regexp_extract(line, NUMBER_AND_TITLE, 1), 1, trimmed(F.regexp_extract(line, NUMBER_AND_TITLE, 2)))).when(usable & two, numbered(line, 2, title))

        return F.filter(F.transform(all_lines, at), lambda h: h.isNotNull())

    return let(clean, found)


def heading_paths(found: DataFrame) -> DataFrame:
    """Rows (id, page, line, number, label), number null for a page's start -> those accepted, with the path from there on.

    Accepted is a number in the allowed range that is larger than all such before it; shallower headings close deeper ones.
    """
    order = Window.partitionBy("id").orderBy("page", "line")
    before, here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    eligible = F.when(F.element_at("number", 1).between(1, MAX_TOP_SECTION), F.col("number"))
    most = F.max(eligible).over(before)
    rows = found.withColumn("accepted", eligible.isNotNull() & (most.isNull() | (F.col("number") > most)))
    place = F.struct("page", "line", "label")
    last = [F.last(F.when(F.col("accepted") & (F.size("number") == d + 1), place), ignorenulls=True).over(here) for d in range(DEPTHS)]
    rows = rows.select("*", *[x.alias(f"last{d}") for d, x in enumerate(last)]).where("accepted OR number IS NULL")

    def open_label(d: int) -> Column:
        later = [F.coalesce(F.struct(f"last{e}.page", f"last{e}.line") > F.struct(f"last{d}.page", f"last{d}.line"), F.lit(False)) for e in range(d)]
        closed = later[0] if later else F.lit(False)
        for x in later[1:]:
            closed = closed | x
        return F.when(~closed, F.col(f"last{d}.label"))

    return rows.withColumn("section", F.nullif(F.concat_ws(SECTION_SEPARATOR, *[open_label(d) for d in range(DEPTHS)]), F.lit("")))


def bookmark_paths(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """(id, page, section): each page of a document with bookmarks under the path after its last one.

    A bookmark at level n keeps the n - 1 elements above it; those of pages that are not there count for nothing.
    """
    marked = outline.select(F.col("id").alias("of")).distinct()
    pages = pages.join(marked, F.col("id") == F.col("of")).drop("of")
    here = outline.join(pages.select("id", "page").distinct(), ["id", "page"], "left_semi")
    marks = here.groupBy(F.col("id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("page", "place", "level", "title"))).alias("marks"))
    upto = F.filter(F.coalesce("marks", F.array().cast("array<struct<page:int,place:int,level:int,title:string>>")), lambda m: m["page"] <= F.col("page"))
    parts = F.aggregate(upto, F.array().cast("array<string>"), lambda path, m: F.concat(F.slice(path, F.lit(1), F.greatest(m["level"] - 1, F.lit(0))), F.array(trimmed(m["title"]))))
    return pages.join(marks, F.col("id") == F.col("of"), "left").select("id", "page", F.nullif(F.array_join(parts, SECTION_SEPARATOR), F.lit("")).alias("section"))


def numbered_sections(pages: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """(id, page, text), and bookmarks (id, page, place, level, title) -> (id, place, page, section, text).

    With bookmarks every page is one section; a page of contents is one too; all others are cut at accepted headings, whose
    path goes on to the next page. Pages without text are left out.
    """
    pages = pages.where(F.length("text") > 0).select("id", "page", "text")
    whole = pages.where(is_contents_page(F.col("text"))).select("id", "page", F.lit(0).alias("part"), F.lit("Contents").alias("section"), "text")
    cut = pages.where(~is_contents_page(F.col("text")))
    if outline is not None:
        marked = outline.select(F.col("id").alias("of")).distinct()
        by_mark = pages.join(bookmark_paths(pages.select("id", "page"), outline), ["id", "page"]).select("id", "page", F.lit(0).alias("part"), "section", "text")
        whole = whole.join(marked, F.col("id") == F.col("of"), "left_anti").unionByName(by_mark)
        cut = cut.join(marked, F.col("id") == F.col("of"), "left_anti")
    cut = cut.withColumn("lines", lines_of(F.col("text")))
    start = F.array(F.struct(F.lit(-1).alias("line"), F.lit(1).alias("used"), F.lit(None).cast("array<int>").alias("number"), F.lit(None).cast("string").alias("label")))
    found = cut.select("id", "page", F.explode(F.concat(start.cast(HEADING), headings(F.col("lines")).cast(HEADING))).alias("h")).select("id", "page", "h.*")
    states = heading_paths(found).groupBy(F.col("id").alias("of"), F.col("page").alias("of_page")).agg(F.array_sort(F.collect_list(F.struct("line", "used", "label", "section"))).alias("states"))
    rows = cut.join(states, (F.col("id") == F.col("of")) & (F.col("page") == F.col("of_page")))

    def part(s: Column, i: Column) -> Column:
        first = s["line"] + s["used"]
        end = F.coalesce(F.get("states", i + 1)["line"], F.size("lines"))
        held = F.concat(F.when(s["label"].isNull(), F.array().cast("array<string>")).otherwise(F.array(s["label"])), F.slice("lines", first + 1, F.greatest(end - first, F.lit(0))))
        return F.struct(s["section"].alias("section"), trimmed(F.array_join(held, "\n")).alias("text"))

    parts = F.filter(F.transform("states", part), lambda p: p["text"] != "")
    cut = rows.select("id", "page", F.posexplode(parts).alias("part", "p")).select("id", "page", "part", "p.section", "p.text")
    place = F.row_number().over(Window.partitionBy("id").orderBy("page", "part")) - 1
    return whole.unionByName(cut).select("id", place.alias("place"), "page", "section", "text")


def sized_units(text: Column, most: int) -> Column:
    """Units (text, tokens); one that is too long is cut into equal runs of words, a tenth below the limit."""

    def cut(u: Column, n: Column) -> Column:
        def by_words(words: Column) -> Column:
            step = F.greatest(F.lit(1), F.floor(F.size(words) * most / n * 0.9).cast("int"))
            runs = F.transform(F.sequence(F.lit(1), F.size(words), step), lambda at: F.array_join(F.slice(words, at, step), " "))
            return F.transform(runs, lambda r: F.struct(r.alias("text"), fallback_tokens(r).cast("int").alias("tokens")))

        return F.when(n <= most, F.array(F.struct(u.alias("text"), n.alias("tokens")))).otherwise(let(words_of(u), by_words))

    return F.flatten(F.transform(paragraph_units(text), lambda u: let(fallback_tokens(u).cast("int"), lambda n: cut(u, n))))


def packed(units: Column, most: int, overlap: int) -> Column:
    """Chunks (text, tokens) of units in order: as many as fit, the next one beginning with the last few of the one before.

    Carried over are the units at the end that have ``overlap`` tokens at most, and none if the next one would not fit then.
    """

    def spans(upto: Column) -> Column:
        """upto: running sizes from 0 on. A chunk is a range of units, from ``next`` of the one before.

        A unit has a token at least, so what can be in a chunk is among the next ``most``: no step looks further.
        """
        n = F.size(upto) - 1
        size = lambda k: F.element_at(upto, k + 1)

        def add(state: Column, _: Column) -> Column:
            first = state["next"]

            def from_here(sizes: Column) -> Column:
                """sizes: those from the first unit on."""
                below = lambda test: first + F.size(F.filter(sizes, test))

                def ended(end: Column) -> Column:
                    carried = below(lambda x: x < size(end) - overlap)
                    after = F.when(size(F.least(end + 1, n)) - size(carried) > most, end).otherwise(carried)
                    return F.struct(F.when(end == n, n).otherwise(after).alias("next"), F.concat(state["all"], F.array(F.struct(first.alias("a"), end.alias("b")))).alias("all"))

                return let(F.greatest(first + 1, below(lambda x: x <= size(first) + most) - 1), ended)

            return F.when(first < n, let(F.slice(upto, first + 1, F.lit(most + 2)), from_here)).otherwise(state)

        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<a:int,b:int>>").alias("all"))
        return F.transform(F.aggregate(units, start, add)["all"], lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), (size(s["b"]) - size(s["a"])).alias("tokens")))

    upto = F.concat(F.array(F.lit(0)), running_sums(F.transform(units, lambda u: u["tokens"])))
    joined = lambda s: F.array_join(F.transform(F.slice(units, s["a"] + 1, s["b"] - s["a"]), lambda u: u["text"]), "\n\n")
    return F.transform(let(upto, spans), lambda s: F.struct(joined(s).alias("text"), s["tokens"].alias("tokens")))


def limit_of(model: str, most: int = CHUNK_TOKENS) -> int:
    """Tokens of a chunk, with room for its header within what the model reads."""
    return min(most, MODEL_MAX_TOKENS[model] - MODEL_RESERVE)


def chunks(segments: DataFrame, keep: list[str], *, most: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, text_col: str = "segment") -> DataFrame:
    """(keep, piece, text, tokens): the chunks of every segment; a chunk never crosses one."""
    rows = segments.select(*keep, sized_units(F.coalesce(F.col(text_col), F.lit("")), most).alias("units"))
    return rows.select(*keep, F.posexplode(packed(F.col("units"), most, overlap)).alias("piece", "c")).select(*keep, "piece", "c.text", "c.tokens")


def file_chunks(segments: DataFrame, model: str, *, most: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Segments (file_id, file_name, place, loc_type, page, line_start, line_end, heading, segment) -> chunks to be indexed.

    (file_id, ordinal, place, label, header, text, tokens): chunks without content are left out, and the others numbered
    through each file. Chunks of pages that are no more than their section's title have no content.
    """
    keep = ["file_id", "file_name", "place", "loc_type", "page", "line_start", "line_end", "heading"]
    made = chunks(segments, keep, most=limit_of(model, most), overlap=overlap)
    title = F.when(F.col("loc_type") == "page", F.col("heading"))
    label = location_label(F.col("loc_type"), page=F.col("page"), first=F.col("line_start"), last=F.col("line_end"), heading=F.col("heading"))
    header = source_header(F.col("file_name"), label, section_of(F.col("loc_type"), F.col("heading")))
    ordinal = F.row_number().over(Window.partitionBy("file_id").orderBy("place", "piece")) - 1
    return made.where(has_content(F.col("text"), title)).select("file_id", ordinal.alias("ordinal"), "place", label.alias("label"), header.alias("header"), "text", "tokens")
