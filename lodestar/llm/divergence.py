"""How the sources of a language differ in their terms, by wide term vectors.

Each kept term of a language becomes one row with an array that has a place for every source of the language: the term's
counts. Higher-order functions turn the array into shares and emit one contribution for each ordered pair of sources that
have the term; sums of contributions are made in the task before the shuffle, so what moves is one number per task and pair.

A term that a source lacks contributes to a pair what any such term does. So a pair's value begins with all terms as if both
lacked them; what a term's count in one of the two changes is added from a histogram of that source's counts; and what is
emitted by term is what is left where both have it. A term that k of n sources have emits a row for each two of the k, not for each two of the n.

All numbers are integers. Shares are out of ``UNITS`` = 10**9; a group's kept occurrences plus the number of kept terms may be
9 * 10**15 at most. The sums stay below 2**63 for 10**9 kept terms.

What grows with the data: counts by (language, source, term), summed in the worker that reads the texts (up to ``MOST_HELD`` terms
at a time) and again in the task before they are shuffled, and the table of kept terms, written once. Sources are lists of one
language's groups, in a table of one row per language: broadcast up to ``MOST_BROADCAST`` groups, joined beyond it.

Every row is a document. Defined results: null text, lang and source are empty strings; texts without terms still make
their group occur; languages without a kept term have pairs of value 0 and no terms; repeated rows count each time; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.lineage import tabled
from lodestar.llm.shared import let, text_column

#: A term is a run of ASCII letters and characters beyond ASCII, as it is in UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xFF]+")
#: Counts that a worker holds before it hands them on; texts of more bytes are not made a list of words at once.
MOST_HELD, LONG_TEXT = 600_000, 1 << 22
MIN_DOCS = 3
MOST_TERMS = 200
UNITS = 10**9
#: Groups (language, source) whose names and totals are broadcast; more are joined.
MOST_BROADCAST = 200_000


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs): occurrences and documents. bytes.lower() lowers A-Z alone."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in held.items():
            if counts:
                k = len(counts)
                terms = pa.array(list(counts), pa.binary()).cast(pa.string())
                n, d = (np.fromiter(x, dtype=np.int64, count=k) for x in (counts.values(), map(docs.__getitem__, counts)))
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, k), pa.repeat(source, k), terms, pa.array(n), pa.array(d)], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            data = text.encode().lower()
            if len(data) > LONG_TEXT:
                counts.update(m[0] for m in TERM.finditer(data))
                docs.update({m[0] for m in TERM.finditer(data)})
            else:
                words = TERM.findall(data)
                counts.update(words)
                docs.update(set(words))
        if sum(len(c) for c, _ in held.values()) > MOST_HELD:
            yield from hand_on()
    yield from hand_on()


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(UNITS * (count + 1) / (total + n_terms)), exactly; in steps of 1,000 where the product does not fit."""
    c, m = count + 1, total + n_terms
    k = F.lit(1000).cast("long")
    first, second = (c * k) % m, (((c * k) % m) * k) % m
    steps = (_div(c * k, m) * k + _div(first * k, m)) * k + _div(second * k, m)
    return F.when(c < 9 * 10**9, _div(c * F.lit(UNITS).cast("long"), m)).otherwise(steps) + 1


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _documents(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    empty = F.lit("")
    return docs.select(F.coalesce(text_column(docs, f"`{text_col}`"), empty).alias("text"), *[F.coalesce(F.col(f"`{c}`").cast("string"), empty).alias(n) for n, c in (("lang", lang_col), ("source", source_col))])


def kept_terms(rows: DataFrame, places: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, counts): the sorted (place, n) of the sources that have the term, for terms in enough documents."""
    each = rows.select("lang", "source", "text").mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    counted = each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counted.join(places, ["lang", "source"]).groupBy("lang", "term")
    return by_term.agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("place", "n"))).alias("counts")).filter(F.col("docs") >= min_docs).select("lang", "term", "counts")


def _wide(counts: Column, size: Column) -> Column:
    """The sorted (place, n) as an array of ``size`` numbers, zero where there is no entry, in one pass."""

    def filled(c: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), F.transform(c, lambda x: x["place"]))
        runs = F.zip_with(c, F.slice(before, F.lit(1), F.size(c)), lambda x, b: F.concat(F.array_repeat(F.lit(0).cast("long"), x["place"] - b - 1), F.array(x["n"])))
        return F.concat(F.flatten(runs), F.array_repeat(F.lit(0).cast("long"), size - F.element_at(before, -1) - 1))

    return let(counts, filled)


def _pairs(wide: Column, shares: Column, absent: Column) -> Column:
    """(a, b, there, back) for the pairs of places that have the term, each pair once: a's divergence from b and b's from a, less what
    the histograms count for each of them without regard to the other; but for what two places without it would have, which is
    added by the number of terms."""

    def one(a: Column, b: Column) -> Column:
        return divergence(a["p"], b["p"]) - divergence(a["p"], b["p0"]) - divergence(a["p0"], b["p"])

    def of(a: Column, b: Column) -> Column:
        return F.struct(a["i"].alias("a"), b["i"].alias("b"), one(a, b).alias("there"), one(b, a).alias("back"))

    places = F.filter(F.sequence(F.lit(0), F.size(wide) - 1), lambda i: F.get(wide, i) > 0)
    having = F.transform(places, lambda i: F.struct(i.alias("i"), F.get(shares, i).alias("p"), F.get(absent, i).alias("p0")))
    after = lambda h, at: F.slice(h, at + 2, F.size(h))
    return let(having, lambda h: F.flatten(F.transform(h, lambda a, at: F.transform(after(h, at), lambda b: of(a, b)))))


def _one_sided(terms: DataFrame, langs: DataFrame, near) -> DataFrame:
    """(lang, a, b, value): what the counts of one source add to its pairs, as if the other had none of its terms."""
    n_terms = F.col("n_terms")
    histogram = terms.select("lang", F.explode("counts").alias("x")).groupBy("lang", F.col("x.place").alias("a"), "x.n").agg(F.count("*").alias("terms"))
    known = histogram.join(near(langs), "lang").withColumn("p", share(F.col("n"), F.get("totals", F.col("a")), n_terms)).withColumn("p0", F.get("absent", F.col("a")))
    each = known.select("lang", "a", "terms", "p", "p0", F.posexplode("absent").alias("b", "q0")).filter("a <> b")
    there = each.select("lang", "a", "b", (F.col("terms") * (divergence(F.col("p"), F.col("q0")) - divergence(F.col("p0"), F.col("q0")))).alias("value"))
    back = each.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), (F.col("terms") * (divergence(F.col("q0"), F.col("p")) - divergence(F.col("q0"), F.col("p0")))).alias("value"))
    return there.unionByName(back)


def source_divergence(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, most_terms: int = MOST_TERMS
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    ``pair``: how far the source's shares are from those of each other source of its language. ``term``: the terms that the
    source has more of than its language, by their part in its distance from the language, down to ``most_terms``.
    """
    rows = _documents(docs, text_col, lang_col, source_col)
    named = tabled(rows.groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("sources")))
    few = named.agg(F.sum(F.size("sources"))).first()[0] or 0
    near = F.broadcast if few <= MOST_BROADCAST else lambda df: df
    places = named.select("lang", F.posexplode("sources").alias("place", "source"))
    terms = tabled(kept_terms(rows, near(places), min_docs))

    sums = terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.place").agg(F.sum("c.n").alias("n"))
    totals = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("totals"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("n_terms"))
    known = named.join(sizes, "lang", "left").join(totals, "lang", "left").select("lang", "sources", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), _wide(F.coalesce("totals", F.array().cast("array<struct<place:int,n:bigint>>")), F.size("sources")).alias("totals"))
    zero, n_terms = F.lit(0).cast("long"), F.col("n_terms")
    total = F.aggregate("totals", zero, lambda s, x: s + x)
    langs = tabled(known.withColumn("total", total).withColumn("absent", F.when(n_terms > 0, F.transform("totals", lambda t: share(zero, t, n_terms)))))

    met = terms.join(near(langs), "lang").withColumn("wide", _wide(F.col("counts"), F.size("sources")))
    met = met.withColumn("shares", F.zip_with("wide", "totals", lambda n, t: share(n, t, n_terms)))

    emitted = met.select("lang", F.explode(_pairs(F.col("wide"), F.col("shares"), F.col("absent"))).alias("p")).select("lang", "p.*")
    emitted = emitted.groupBy("lang", "a", "b").agg(F.sum("there").alias("there"), F.sum("back").alias("back"), F.count("*").alias("both"))
    ways = F.array(F.struct("a", "b", F.col("there").alias("value")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("value")))
    emitted = emitted.select("lang", "both", F.explode(ways).alias("p")).select("lang", "p.*", "both")
    all_places = F.sequence(F.lit(0), F.size("sources") - 1)
    at_least = langs.select("lang", "n_terms", "absent", F.explode(all_places).alias("a"), all_places.alias("bs")).select("lang", "n_terms", "absent", "a", F.explode("bs").alias("b")).filter("a <> b")
    base = F.when(n_terms > 0, divergence(F.get("absent", F.col("a")), F.get("absent", F.col("b")))).otherwise(zero)
    at_least = at_least.select("lang", "a", "b", (n_terms * base).alias("value"), zero.alias("both"), base.alias("base"))
    one_sided = _one_sided(terms, langs, near).select("lang", "a", "b", "value", zero.alias("both"), zero.alias("base"))
    emitted = emitted.select("lang", "a", "b", "value", "both", zero.alias("base"))
    summed = emitted.unionByName(one_sided).unionByName(at_least).groupBy("lang", "a", "b").agg(*[F.sum(c).alias(c) for c in ("value", "both", "base")])
    pairs = summed.select("lang", "a", "b", (F.col("value") + F.col("both") * F.col("base")).alias("value"))
    pairs = pairs.join(near(langs.select("lang", "sources")), "lang").select("lang", F.get("sources", F.col("a")).alias("source"), F.lit("pair").alias("part"), F.get("sources", F.col("b")).alias("item"), "value")

    own = F.transform("counts", lambda c: F.struct(c["place"].alias("place"), share(c["n"], F.get("totals", c["place"]), n_terms).alias("p")))
    whole = share(F.aggregate("counts", zero, lambda s, c: s + c["n"]), F.col("total"), n_terms)
    above = met.select("lang", "term", "sources", whole.alias("whole"), F.explode(own).alias("o")).filter("o.p > whole")
    above = above.select("lang", "term", "sources", "o.place", divergence(F.col("o.p"), F.col("whole")).alias("value"))
    above = above.select("lang", F.get("sources", F.col("place")).alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(order)), above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_terms)]
    return ranked[0].unionByName(ranked[1])
