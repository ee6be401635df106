"""Fill-in-the-middle documents by escaped marker injection, in string functions only.

A text is cut into units: a run of ASCII letters, or any other single code point. A delimiter is escaped in the text and
written behind every unit; counting it gives the number of units, ``substring_index`` gives the first or the last so many
of them, and what was escaped is undone in the parts. No unit is ever an array element, so that a text of millions of
units is a string of twice its length and nothing more. Rows stay where they are: there is no shuffle.

Where the two cuts are and which form a document takes are functions of its id alone, so that reruns agree.

Forms: ``psm`` is prefix, suffix, middle, each behind its sentinel; ``spm`` is suffix, prefix, middle; ``plain`` is the text
as it is. Texts that hold a sentinel stay plain: that is why the output of the other two can be taken apart again.

Defined results: null texts are empty; empty texts are plain with 0 units; a null id is hashed as an empty string;
repeated rows come out alike; an empty table gives an empty result; input columns named like a result column are replaced.
Characters that serve as the delimiter or its escape may occur in texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import text_column

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that stay plain, and of the others, percent in suffix-first form.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Stands behind every unit; in a text it is written as ESCAPE and 1, and ESCAPE itself as ESCAPE and 0.
DELIMITER, ESCAPE = "\x1f", "\x1a"
UNIT = f"[A-Za-z]+|{ESCAPE}[01]|[^A-Za-z]"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))


def unescaped(part: Column) -> Column:
    """The text of a stretch of marked units: markers go first, then escapes are undone, the delimiter's before the escape's."""
    bare = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def marked(text: Column) -> Column:
    """The escaped text with a delimiter behind every unit. The pattern takes an escape and its digit as one unit."""
    return F.regexp_replace(escaped(text), f"({UNIT})", f"$1{DELIMITER}")


def draws(doc_id: Column) -> Column:
    """Four numbers below 2**32 from the SHA-256 of ``1:`` and the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def _first(units: str, n: str) -> Column:
    return F.expr(f"substring_index({units}, '{DELIMITER}', CAST({n} AS INT))")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Neither part holds a sentinel, and none can arise where two parts meet."""

    def parts(first: str, second: str, then: str, order: tuple[int, int, int]) -> Column:
        body = F.substring(output, F.lit(len(first) + 1), F.length(output))
        a = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(a) + len(second) + 1, F.length(output))
        b = F.substring_index(rest, then, 1)
        found = (a, b, F.substring(rest, F.length(b) + len(then) + 1, F.length(output)))
        return F.concat(*[found[i] for i in order])

    psm, spm = parts(PREFIX, SUFFIX, MIDDLE, (0, 2, 1)), parts(SUFFIX, PREFIX, MIDDLE, (1, 2, 0))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle(
    docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", keep: Sequence[str] | None = None, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """Rows of ``docs`` with n (units), form, prefix, middle, suffix (null if plain) and output.

    ``keep`` names the input columns to carry (all but the text by default).
    """
    made = ["n", "form", "prefix", "middle", "suffix", "output"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made and (keep is not None or c != text_col)]
    text = F.coalesce(text_column(docs, f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("none")]).alias("row"), text.alias("text"), draws(F.col(f"`{id_col}`")).alias("h"))
    rows = rows.withColumn("marked", marked(F.col("text")))
    rows = rows.withColumn("n", (F.length("marked") - F.length(F.replace("marked", F.lit(DELIMITER), F.lit("")))).cast("long"))
    cut = [F.col("h")[i] % (F.col("n") + 1) for i in (0, 1)]
    rows = rows.withColumn("a", F.least(*cut)).withColumn("b", F.greatest(*cut))
    holds = [F.contains("text", F.lit(s)) for s in (PREFIX, SUFFIX, MIDDLE)]
    plain = (F.col("text") == "") | holds[0] | holds[1] | holds[2] | (F.col("h")[2] % 100 >= 100 - plain_percent)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h")[3] % 100 < spm_percent, "spm").otherwise("psm"))
    units = {"prefix": _first("marked", "a"), "middle": _first(f"substring_index(marked, '{DELIMITER}', CAST(b AS INT))", "a - b"), "suffix": _first("marked", "b - n - 1")}
    rows = rows.select("row", "text", "n", "form", *[F.when(F.col("form") != "plain", unescaped(part)).alias(name) for name, part in units.items()])
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in kept], "n", "form", "prefix", "middle", "suffix", output.alias("output"))
