"""Line dedup: lines that many documents share stay in one document only.

Lines are exploded with their position, normalised (white space at the ends stripped, A-Z lower-cased) and hashed to 128
bits; distinct documents are counted for each hash. A hash over the threshold is dropped everywhere but in the largest
id that holds it, and every text is put together again from the stretches between its dropped positions.

What moves: hashes and positions of long lines, summed before the shuffle, to find those with enough rows; then only the
rows of those, to count distinct documents exactly and to find the dropped positions; then each text once, to meet its own
positions (a broadcast of those where Spark finds them small). A line that a third of all documents share is one row per
task in the sums; in the joins the other side has one row for it, right below an exchange that adaptive execution can split.

A document is a doc_id: rows with one id count once and are judged alike; rows with null ids are one document whose id is
below all others. Defined results: null and empty texts are one empty line; repeated rows lose the same lines; an empty
table gives an empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.lineage import remove, tabled
from lodestar.llm.shared import ASCII_SPACES, ascii_lower, let, text_column

MIN_CHARS = 40
MIN_DOCS = 5
#: Repeated hashes are broadcast up to so many (24 bytes each); more are joined.
MOST_BROADCAST = 200_000


def line_hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """Array of (at, h1, h2) for the lines whose keys have min_chars code points or more; positions from 1."""

    def hashed(line: Column, i: Column) -> Column:
        def of(bare: Column) -> Column:
            return F.when(F.length(bare) >= min_chars, let(ascii_lower(bare), lambda k: F.struct((i + 1).alias("at"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))))

        return let(F.btrim(line, F.lit(ASCII_SPACES)), of)

    return F.filter(F.transform(F.split(text, "\n", -1), hashed), lambda x: x.isNotNull())


def _small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has MOST_BROADCAST rows or fewer; otherwise joined."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def dropped_positions(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, key, text) -> (doc_id, key, gone): the sorted positions that a text loses, for texts that lose any."""
    made: list[str] = []
    lines = tabled(docs.select("doc_id", "key", F.explode(line_hashes(F.col("text"), min_chars)).alias("line")).select("doc_id", "key", "line.*"), made)
    often = tabled(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2"), made)
    repeated = tabled(lines.join(_small(often), ["h1", "h2"]))
    for path in made:
        remove(docs.sparkSession, path)
    each = repeated.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    over = tabled(each.groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs).select("h1", "h2", "keeper"))
    hits = repeated.join(_small(over), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return hits.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def without(lines: Column, gone: Column) -> Column:
    """The lines at other positions than the sorted ones in ``gone``, in one pass over the stretches between them."""

    def stretches(ends: Column) -> Column:
        pairs = F.zip_with(ends, F.slice(ends, F.lit(2), F.size(ends)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.flatten(F.transform(F.slice(pairs, F.lit(1), F.size(ends) - 1), lambda p: F.slice(lines, p["a"] + 1, p["b"] - p["a"] - 1)))

    return let(F.concat(F.array(F.lit(0)), gone, F.array(F.size(lines) + 1)), stretches)


def dedup_lines(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", keep: Sequence[str] | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows of ``docs`` with n_lines, n_dropped and kept_text.

    ``keep`` names the input columns to carry (all but the text by default).
    """
    made = ["n_lines", "n_dropped", "kept_text"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made and (keep is not None or c != text_col)]
    text = F.coalesce(text_column(docs, f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("none")]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))  # with the id it says which text: rows with the same of both lose the same lines
    gone = dropped_positions(rows.select("doc_id", "key", "text"), min_chars=min_chars, min_docs=min_docs)
    gone = gone.select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "gone")
    met = rows.join(gone, F.col("key").eqNullSafe(F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    lines = F.split("text", "\n", -1)
    met = met.withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
    rest = F.when(F.col("n_dropped") > 0, let(lines, lambda x: F.array_join(without(x, F.col("gone")), "\n"))).otherwise(F.col("text"))
    return met.select(*[F.col("row").getField(c).alias(c) for c in kept], "n_lines", "n_dropped", rest.alias("kept_text"))
