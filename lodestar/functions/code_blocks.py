"""Code in answers comes from the sources or not at all: blocks of code against the sources' samples, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.constants import MAX_EXCERPT_LINES, MIN_STATEMENTS, SAMPLE_BONUS
from lodestar.functions.answer_text import plain
from lodestar.functions.arrays import let
from lodestar.functions.text import code_lines, identifiers, normal_code

# What code, samples and their ends look like.
FENCE = r"(?s)```[^\n]*\n(.*?)(?:```|\z)"
SAMPLE_START = r"(?im)^\s*(Sample (API|Method|WinDev API) Call|Step 1\b)"
END_HEADINGS = "Successful Response|Error Handling|Failure Response|Error Response|Notes|Request URL Example|ErrorItem Definition|Processing Flow|Example Output|Meaning"
SAMPLE_END = rf"(?i)(?<=\n)\s*(?:{END_HEADINGS})[^\S\n]*(?:\n|\z)"
STATEMENT = r"[A-Za-z_][\w.]*\s*(=(?!=)|\()"
ASKS_FOR_CODE = r"(?i)\b(code|sample|example|snippet|syntax|how (do|to) (i )?call|usage)\b"
DEFINITION = r"(?m)^[ \t]*(?:PROCEDURE[ \t]+)?(\w+)\([^()]*\)[ \t]*:[ \t]*\w+"
PAGE_NUMBER = r"^\s*\d{1,4}\s*\n"
NO_SAMPLE = "_The documents don't include a code sample for this._"
LEAST_CODE_LINES, MOST_CODE_LINES = 3, 10


def verbatim(block: Column, sources: Column) -> Column:
    """Whether every line of a block is in the sources word for word."""
    return let(normal_code(F.array_join(sources, "\n")), lambda whole: F.forall(F.transform(F.split(block, "\n"), normal_code), lambda line: (line == "") | F.contains(whole, line)))


def is_program(block: Column) -> Column:
    """Code with some statements, rather than a value or a name in a frame."""
    return F.size(F.filter(F.split(block, "\n"), lambda line: F.regexp_like(line, F.lit(STATEMENT)))) >= MIN_STATEMENTS


def likeliest(wanted: Column, sources: Column) -> Column:
    """The place (from 1) of the source with the likeliest sample, null if none has code.

    A worked example counts most, then lines of code and names that are wanted; later sources count less.
    """

    def score(s: Column, k: Column) -> Column:
        n = code_lines(s)
        value = F.when(F.regexp_like(s, F.lit(SAMPLE_START)), SAMPLE_BONUS).otherwise(0) + F.size(F.array_intersect(wanted, identifiers(s))) + 2 * F.least(n, F.lit(MOST_CODE_LINES)) - k
        return F.when(n >= LEAST_CODE_LINES, F.struct(value.alias("score"), (k + 1).alias("place")))

    return F.array_max(F.filter(F.transform(sources, score), lambda x: x.isNotNull()))["place"]


def cut_sample(first: Column, sources: Column, after: Column) -> Column:
    """(text, used): the sample that begins in a source, up to the heading after it, over the sources that it goes on in.

    ``after`` maps a source's place to the one that follows it in the document.
    """
    start = F.element_at(sources, first)
    begun = F.substring(start, F.greatest(F.regexp_instr(start, F.lit(SAMPLE_START)), F.lit(1)), F.length(start))
    follows = lambda used: F.try_element_at(after, F.element_at(used, -1))
    on = lambda used: F.when(follows(used).between(1, F.size(sources)), follows(used))
    chain = F.aggregate(sources, F.array(first), lambda used, _: F.when(on(used).isNull() | F.array_contains(used, on(used)), used).otherwise(F.concat(used, F.array(on(used)))))
    body = lambda k: F.regexp_replace(F.element_at(sources, k), PAGE_NUMBER, "")

    def through(places: Column) -> Column:
        def upto(n: Column) -> Column:
            pages = F.transform(F.slice(places, F.lit(2), n - 1), body)
            return let(F.concat_ws("\n", F.array(begun), pages), lambda t: F.struct(t.alias("text"), F.slice(places, F.lit(1), n).alias("used"), F.regexp_instr(t, F.lit(SAMPLE_END)).alias("stop")))

        def ended(options: Column) -> Column:
            return F.coalesce(F.try_element_at(F.filter(options, lambda o: o["stop"] > 0), F.lit(1)), F.element_at(options, -1))

        return let(F.transform(F.sequence(F.lit(1), F.size(places)), upto), ended)

    def shortened(o: Column) -> Column:
        text = F.when(o["stop"] > 0, F.left(o["text"], o["stop"] - 1)).otherwise(o["text"])

        def shown(t: Column) -> Column:
            flat = normal_code(t)
            still = F.filter(o["used"], lambda k: (k == first) | F.contains(flat, F.left(normal_code(body(k)), F.lit(40))))
            lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"\s+\z", "")), lambda x: x != "")
            return F.struct(F.array_join(F.slice(lines, 1, MAX_EXCERPT_LINES), "\n").alias("text"), F.when(o["stop"] > 0, still).otherwise(o["used"]).alias("used"))

        return let(text, shown)

    return let(let(chain, through), shortened)


def definition(sample: Column, sources: Column) -> Column:
    """(place, text) of the first called method that a source defines, in the order of the calls; null if there is none."""

    def found_in(s: Column, k: Column) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(s, F.lit(DEFINITION), F.lit(1)).alias("name"), F.regexp_extract_all(s, F.lit(DEFINITION), F.lit(0)).alias("text"))
        return F.transform(both, lambda d: F.struct(d["name"].alias("name"), (k + 1).alias("place"), d["text"].alias("text")))

    calls = F.array_distinct(F.regexp_extract_all(sample, F.lit(r"\.(\w+)\("), F.lit(1)))
    ordered = lambda all_of: F.flatten(F.transform(calls, lambda name: F.filter(all_of, lambda d: d["name"] == name)))
    return let(F.flatten(F.transform(sources, found_in)), lambda all_of: F.try_element_at(ordered(all_of), F.lit(1)))


def quoted(first: Column, sources: Column, after: Column) -> Column:
    """What an answer says in place of invented code: the sources' sample, and how its method is defined."""
    full = lambda text: F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\s+\z", "")), lambda x: x != ""), "\n")

    def with_sample(s: Column) -> Column:
        def head(d: Column) -> Column:
            says = F.concat(F.lit("The documents define the method as ["), d["place"].cast("string"), F.lit("]:\n\n```text\n"), full(d["text"]), F.lit("\n```\n\n"))
            return F.when(d.isNotNull() & ~F.contains(normal_code(s["text"]), normal_code(full(d["text"]))), says).otherwise("")

        return F.concat(let(definition(s["text"], sources), head), F.lit("The documents show this sample "), plain(s["used"]), F.lit(":\n\n```text\n"), s["text"], F.lit("\n```"))

    return let(cut_sample(first, sources, after), with_sample)


def guarded(answer: Column, sources: Column, question: Column, after: Column) -> Column:
    """(text, changes): code that is not in the sources replaced by theirs; a sample added if one was asked for.

    The first block that a sample stands for shows it, later ones point at it.
    """
    blocks = F.arrays_zip(F.regexp_extract_all(answer, F.lit(FENCE), F.lit(0)).alias("whole"), F.regexp_extract_all(answer, F.lit(FENCE), F.lit(1)).alias("code"))

    def judged(b: Column) -> Column:
        own = verbatim(b["code"], sources)
        best = F.when(~own, likeliest(F.array_union(identifiers(b["code"]), identifiers(question)), sources))
        return let(own, lambda v: F.struct(b["whole"].alias("whole"), v.alias("own"), best.alias("best"), (v & is_program(b["code"])).alias("program")))

    def replaced(all_of: Column) -> Column:
        places = F.transform(all_of, lambda b: F.coalesce(b["best"], F.lit(0)))

        def one(b: Column, i: Column) -> Column:
            again = F.concat(F.lit("_See the sample from the documents above ["), b["best"].cast("string"), F.lit("]._"))
            sample = F.when(F.array_position(places, b["best"]) <= i, again).otherwise(quoted(b["best"], sources, after))
            return F.when(b["own"], b["whole"]).when(b["best"].isNull(), NO_SAMPLE).otherwise(sample)

        text = F.array_join(F.zip_with(F.split(answer, FENCE, -1), F.transform(all_of, one), lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
        return F.struct(text.alias("text"), F.size(F.filter(all_of, lambda b: ~b["own"])).alias("changes"), F.exists(all_of, lambda b: b["program"] | b["best"].isNotNull()).alias("real"))

    def completed(g: Column) -> Column:
        best = F.when(~g["real"] & F.regexp_like(question, F.lit(ASKS_FOR_CODE)), likeliest(F.array_union(identifiers(question), identifiers(g["text"])), sources))
        added = lambda k: F.struct(F.concat(F.regexp_replace(g["text"], r"\s+\z", ""), F.lit("\n\n"), quoted(k, sources, after)).alias("text"), (g["changes"] + 1).alias("changes"))
        return let(best, lambda k: F.when(k.isNotNull(), added(k)).otherwise(F.struct(g["text"].alias("text"), g["changes"].alias("changes"))))

    return let(let(F.transform(blocks, judged), replaced), completed)
