"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue. Its documents are shuffled (by a hash of id and text), and a document's virtual finish time is
the words its source has queued up to and including it, divided by the source's target. Queues whose target exceeds
their size are queued again (a second pass follows the first, and so on up to ``max_repeat``). All copies in order of
finish time, up to the total budget, are the mix.

Nothing is gathered per source: running sums go over (source, hash bucket), buckets being as many as the rows need, and
their offsets come from one sum per bucket. The global order is cut into ranges of finish time; ranges before the one
in which the budget ends are taken whole and only that one range is sorted. Only two things are ever in one task: one
row per source, and that one range (about ``ROWS_A_RANGE`` rows).

Defined results: null text has size 0; a null source is a source of its own, after all others; null and repeated ids
are ordinary rows, ties between them fall to rows that differ in nothing the result shows; documents of size 0 take
nothing; a source of size 0 has target 0; an empty table gives an empty result. Columns of the input that are named
like a result column are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import count_words, cut_lineage, power_of_two, text_column

ROWS_A_BUCKET = 20_000
ROWS_A_RANGE = 50_000
RANGES = 4_096
BROADCAST_SOURCES = 10_000
KEY_BITS = 60


def shuffle_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A place in the shuffled order: the first 60 bits of an MD5 over seed, id and the text's MD5.

    The text is in it so that rows with one id, or none, do not share a place (and with it a bucket).
    """
    what = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(what.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], ratio: float, max_repeat: int) -> DataFrame:
    """One row per source (source, source_size) -> with target.

    Weights repeat over the sources in code-point order. Targets share ``ratio`` of all sizes by weight; whatever
    exceeds ``max_repeat`` times a source's size is shared again among the rest. That fixed point is a water level:
    with sources ordered by cap over weight, those below the level take their cap, the others level times weight.
    """
    everything = Window.partitionBy()
    named = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = named.withColumn("weight", weight).withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    before = Window.orderBy("fill", "place").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        caps.withColumn("rank", F.row_number().over(Window.orderBy("fill", "place")))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("budget", F.lit(float(ratio)) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - F.col("cap_before")) / (F.sum("weight").over(everything) - F.col("weight_before")))
        .withColumn("first_free", F.min(F.when(F.col("fill") > F.col("level"), F.col("rank"))).over(everything))
        .withColumn("water", F.max(F.when(F.col("rank") == F.col("first_free"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("first_free").isNull() | (F.col("rank") < F.col("first_free")), F.col("cap")).otherwise(F.col("water") * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"), "budget")


def _queue(docs: DataFrame, kept: Sequence[str], weights, ratio, max_repeat, seed, id_col, text_col, source_col):
    """Every row with its place in its source's queue, and the cut of the global order."""
    base = cut_lineage(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            count_words(text_column(docs, text_col)).alias("size"),
            shuffle_key(F.col(id_col), text_column(docs, text_col), seed).alias("key"),
        )
    )
    n = base.count()
    bits = power_of_two(n / ROWS_A_BUCKET, 256, 1 << 20).bit_length() - 1
    base = base.withColumn("bucket", F.shiftright("key", KEY_BITS - bits))
    counts = base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(counts.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, ratio, max_repeat)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    offsets = cut_lineage(
        offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select(F.col("o.source").alias("of_source"), F.col("o.bucket").alias("of_bucket"), "offset", "source_size", "target", "budget")
    )
    within = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        base.withColumn("run", F.sum("size").over(within))
        .join(offsets, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket")))
        .withColumn("cum", F.col("offset") + F.col("run"))
    )

    def finish(epoch: int) -> Column:
        return (F.col("cum") + F.lit(epoch) * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target"))

    def place(epoch: int) -> Column:
        return F.struct(finish(epoch).alias("finish"), F.col("key").alias("key"), F.col("source").alias("source"), F.lit(epoch).alias("epoch"))

    queued = cut_lineage(queued.select("row", "id", "size", "source", "source_size", "target", "budget", "cum", "key"))
    copies = (
        queued.filter((F.col("size") > 0) & (F.col("target") > 0))
        .select("size", "budget", F.explode(F.array(*[place(e) for e in range(max_repeat)])).alias("place"))
    )
    cut = _cut(copies)
    if cut is None:
        return queued, [F.lit(0)] * max_repeat
    limit = F.struct(F.lit(cut["finish"]).alias("finish"), F.lit(cut["key"]).alias("key"), F.lit(cut["source"]).cast(queued.schema["source"].dataType).alias("source"), F.lit(cut["epoch"]).alias("epoch"))
    return queued, [F.when((F.col("size") > 0) & (F.col("target") > 0) & (place(e) <= limit), 1).otherwise(0) for e in range(max_repeat)]


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    ratio: float = 1.5,
    max_repeat: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of ``docs`` with size, source_size, target, copies and taken (= copies * size).

    ``keep`` names the input columns to carry (all by default); a caller that only needs decisions leaves the text out.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    queued, taken = _queue(docs, kept, weights, ratio, max_repeat, seed, id_col, text_col, source_col)
    copies = sum(taken[1:], taken[0]).cast("long")
    return queued.withColumn("copies", copies).select(*[F.col("row").getField(c).alias(c) for c in kept], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_texts(
    docs: DataFrame,
    columns: Sequence[str],
    *,
    weights: Sequence[float] = (5, 2, 1),
    ratio: float = 1.5,
    max_repeat: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: the ``columns`` of every document that is taken, once for each time.

    Within a source the queue is in order of key, id and size, so what is taken is all up to some place. Only these
    places (one per source and pass) meet the texts, which are not shuffled. Rows equal in id and text are taken alike. The
    rows stay in the order of the input: whoever trains on them shuffles them by sequence.
    """
    queued, taken = _queue(docs, [], weights, ratio, max_repeat, seed, id_col, text_col, source_col)
    spot = F.struct("key", "id", "size")
    last = queued.groupBy("source").agg(*[F.max(F.when(t == 1, spot)).alias(f"last{e}") for e, t in enumerate(taken)])
    last = cut_lineage(last.withColumnRenamed("source", "of_source"))
    rows = docs.withColumns({"__size": count_words(text_column(docs, text_col)), "__key": shuffle_key(F.col(id_col), text_column(docs, text_col), seed)})
    few = last.count() <= BROADCAST_SOURCES
    rows = rows.join(F.broadcast(last) if few else last, F.col(source_col).eqNullSafe(F.col("of_source")))
    own = F.struct(F.col("__key").alias("key"), F.col(id_col).alias("id"), F.col("__size").alias("size"))
    copies = sum((F.when((F.col("__size") > 0) & (own <= F.col(f"last{e}")), 1).otherwise(0) for e in range(max_repeat)), F.lit(0))
    return rows.withColumn("__copies", copies).filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*columns)


def _cut(copies: DataFrame):
    """The last place of the global order that fits the budget, as a row; None if nothing fits.

    The finish times are dealt into RANGES equal ranges, ranges before the budget's end are taken by their sums, and
    the range that holds it is dealt again until it has few rows (or one finish time); only that range is sorted.
    """
    head = copies.agg(F.min("place.finish").alias("lo"), F.max("place.finish").alias("hi"), F.max("budget").alias("budget")).first()
    if head["budget"] is None:
        return None
    lo, hi, budget, before, part = head["lo"], head["hi"], head["budget"], 0, copies
    for _ in range(8):
        if not hi > lo:
            break
        width = (hi - lo) / RANGES
        ranged = part.withColumn("range", F.least(F.floor((F.col("place.finish") - F.lit(lo)) / F.lit(width)), F.lit(RANGES - 1)))
        sums = sorted((r["range"], r["size"], r["n"], r["lo"], r["hi"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("place.finish").alias("lo"), F.max("place.finish").alias("hi")).collect())
        at, n = sums[-1][0], sums[-1][2]
        for at, size, n, lo, hi in sums:
            if before + size > budget or at == sums[-1][0]:
                break
            before += size
        part = ranged.filter(F.col("range") == at).drop("range")
        if n <= ROWS_A_RANGE:
            break
    order = Window.partitionBy().orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    last = part.withColumn("total", F.lit(before) + F.sum("size").over(order))
    found = last.filter(F.col("total") <= budget).agg(F.max("place").alias("place")).first()["place"]
    if found is None and before:  # the range's first copy is over the budget: the cut is the end of the range before
        found = copies.filter(F.col("place.finish") < F.lit(lo)).agg(F.max("place").alias("place")).first()["place"]
    return found
