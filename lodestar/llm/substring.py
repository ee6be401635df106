"""Removing passages that an earlier document has: exact, behind a count-min prefilter.

A word goes if it lies in a window of ``width`` words whose word sequence also starts in a document with a smaller id.

1. Every partition sketches how often it has each window: a count-min sketch with two rows of counters that stop at
   two, keyed by the window's representative (see ``windows``), which can only make counts larger. The sketches are
   merged counter by counter, streaming, one slice of counters per task. What remains is one bit per counter.
2. A second pass keeps the windows that the sketch calls repeated, as blocks, and groups them exactly: first whole
   blocks by their words, where all but the smallest id are repeats; then, for representatives that occur in different
   surroundings, the single windows. No window that is repeated is lost, and none is removed on an estimate.
3. Only documents with a repeat are read a third time, joined with their repeated stretches.

The sketch grows with the corpus. Up to ``MOST_BROADCAST`` counters a row its bits are broadcast (2 * counters / 8 bytes:
32 MiB); beyond that the blocks, which are narrow rows, are sent to the slice that has both their counters (dealt over
``SALTS`` copies of it, since one passage may be in a third of all documents). Bit maps of ``MARKS`` bits only spare work:
when they fill up, more rows are looked at and the result is the same. Grouping is by aggregates and joins, which
pre-aggregate or are split where one passage is in a third of all documents.

Two stretches count as equal if the 128-bit hashes (XXH3) of their words agree: in 10^15 different windows there is a chance
of one in 10^8 that two of them do. The hashes that the sketch and the marks use decide nothing.

Defined results: null and empty texts have no words; a null id is larger than any other; rows with the same id do not
remove from each other, identical rows get identical results; texts of fewer words than a window keep all; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.shared import cut_lineage, power_of_two, text_column
from lodestar.llm.windows import Blocks, blocks_of, mixed, words_of

WIDTH = 50
SLICE = 1 << 16
LEAST_COUNTERS, MOST_COUNTERS, MOST_BROADCAST = 1 << 20, 1 << 46, 1 << 27
SALTS = 8
#: Counters are about four times the expected blocks: a block per so many bytes of text.
BYTES_A_COUNTER = 32
MARKS = 1 << 25
NO_ID = 2**63 - 1
KEPT_CELLS = 1 << 22


def _counters(gram: np.ndarray, counters: int) -> np.ndarray:
    """The counter of each representative in the first row, then in the second; slices of the rows alternate.

    Both counters of a representative are in neighbouring slices 2 s and 2 s + 1, where s is its pair of slices.
    """
    pair = _pair(gram, counters) * np.uint64(2 * SLICE)
    low = np.uint64(SLICE - 1)
    return np.concatenate([pair + (gram & low), pair + np.uint64(SLICE) + (mixed(gram ^ np.uint64(0x5851F42D4C957F2D)) & low)])


def _pair(gram: np.ndarray, counters: int) -> np.ndarray:
    return mixed(gram) & np.uint64(counters // SLICE - 1)


def _sketch(width: int, counters: int, word_bits: int):
    """Partial sketches: (slice, counters seen once, counters seen twice or more), as 16-bit offsets in the slice."""

    def part(cells: np.ndarray) -> pa.RecordBatch:
        cell, n = np.unique(cells, return_counts=True)
        of, at = np.unique(cell // np.uint64(SLICE), return_index=True)
        once, more = [], []
        for a, b in zip(at, [*at[1:], len(cell)], strict=True):
            offset = (cell[a:b] % np.uint64(SLICE)).astype("<u2")
            once.append(offset[n[a:b] == 1].tobytes())
            more.append(offset[n[a:b] > 1].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(of.astype(np.int64)), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["slice", "once", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for b in blocks_of((words_of(t.as_py()) for t in batch.column(0)), width, word_bits):
                held.append(_counters(b.gram, counters))
            if sum(map(len, held)) > KEPT_CELLS:
                yield part(np.concatenate(held))
                held = []
        if held:
            yield part(np.concatenate(held))

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sketches sorted by slice -> (slice, one bit per counter: two or more)."""
    now, counts = None, np.zeros(SLICE, dtype=np.uint8)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    for batch in batches:
        for of, once, more in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            if of != now:
                if now is not None:
                    yield done()
                now, counts = of, np.zeros(SLICE, dtype=np.uint8)
            counts[np.frombuffer(once, "<u2")] += 1
            counts[np.frombuffer(more, "<u2")] = 2
            np.minimum(counts, 2, out=counts)
    if now is not None:
        yield done()


def repeated_counters(texts: DataFrame, width: int, counters: int, word_bits: int = 64) -> DataFrame:
    """The merged sketch (slice, bits): a bit per counter, set if the counter reached two."""
    parts = texts.mapInArrow(_sketch(width, counters, word_bits), "slice long, once binary, more binary")
    return parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merge, "slice long, bits binary")


def _gathered(sketch: DataFrame, counters: int) -> np.ndarray:
    bits = np.zeros(2 * counters // 8, dtype=np.uint8)
    for row in sketch.toLocalIterator():
        bits[row["slice"] * SLICE // 8 : (row["slice"] + 1) * SLICE // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _by_slice(blocks: DataFrame, sketch: DataFrame, counters: int) -> DataFrame:
    """The blocks that the sketch calls repeated, by sending them to their slices."""
    columns = blocks.schema
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in columns]
    bits = sketch.select(F.shiftright("slice", 1).alias("pair"), salts.alias("salt"), F.col("slice").bitwiseAND(F.lit(1).cast("long")).cast("int").alias("kind"), "bits", *empty)
    rows = blocks.mapInArrow(_paired(counters), T.StructType([T.StructField("pair", T.LongType()), *columns]))
    rows = rows.select("pair", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(2).alias("kind"), F.lit(None).cast("binary").alias("bits"), *columns.names)
    dealt = bits.unionByName(rows).repartition("pair", "salt").sortWithinPartitions("pair", "salt", "kind")
    return dealt.mapInArrow(_looked_up, columns)


def _paired(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column(batch.schema.get_field_index("gram")).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([_signed(_pair(gram, counters)), *batch.columns], names=["pair", *batch.schema.names])

    return run


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (pair, salt, kind): the bits of a pair of slices, then its blocks."""
    now, bits = None, np.zeros((2, SLICE // 8), dtype=np.uint8)
    for batch in batches:
        pair, salt, kind = (batch.column(k).to_numpy() for k in range(3))
        names = batch.schema.names[4:]
        cuts = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])]).tolist() if batch.num_rows else []
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            if (pair[a], salt[a]) != now:
                now, bits = (pair[a], salt[a]), np.zeros((2, SLICE // 8), dtype=np.uint8)
            part = batch.slice(a, b - a)
            if kind[a] < 2:
                bits[kind[a]] = np.frombuffer(part.column(3)[0].as_py(), np.uint8)
                continue
            gram = part.column(part.schema.get_field_index("gram")).to_numpy().view(np.uint64)
            keep = _estimated_repeated(gram, bits.reshape(-1))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in names], names=names).filter(pa.array(keep))


def _is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _estimated_repeated(gram: np.ndarray, bits: np.ndarray) -> np.ndarray:
    both = _is_set(bits, _counters(gram, len(bits) * 8 // 2))
    return both[: len(gram)] & both[len(gram) :]


def _mark(context: np.ndarray, rid: np.ndarray) -> np.ndarray:
    return mixed(context.astype(np.uint64) ^ mixed(rid.astype(np.uint64))) & np.uint64(MARKS - 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _digest(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), 42)


_BLOCK = "rid long, digest long, start long, gram long, n long, key1 long, key2 long, mark long"
_WINDOWS = "rid long, digest long, start long, gram long, windows array<struct<key1:long,key2:long>>"


def _candidates(width: int, word_bits: int, sketch=None, wanted=None):
    """Blocks that the sketch calls repeated (all, without one); with ``wanted`` bits, only marked ones and their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, texts = batch.column(1).to_numpy(), batch.column(0)
            digest = np.fromiter((_digest(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts))
            b: Blocks
            for b in blocks_of((words_of(t.as_py()) for t in texts), width, word_bits):
                mark = _mark(b.context, rid[b.text])
                keep = np.ones(len(mark), dtype=bool) if sketch is None else _estimated_repeated(b.gram, sketch.value)
                if wanted is not None:
                    keep &= _is_set(wanted.value, mark)
                at = np.flatnonzero(keep)
                if not len(at):
                    continue
                out = [pa.array(rid[b.text[at]]), _signed(digest[b.text[at]]), pa.array(b.start[at].astype(np.int64)), _signed(b.gram[at])]
                names = ["rid", "digest", "start", "gram"]
                if wanted is None:
                    key = b.keys(at, width)
                    out += [pa.array(b.count[at].astype(np.int64)), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), _signed(mark[at])]
                    names += ["n", "key1", "key2", "mark"]
                else:
                    sizes, key = b.window_keys(at, width)
                    pairs = pa.StructArray.from_arrays([pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy())], names=["key1", "key2"])
                    out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pairs))
                    names.append("windows")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _gather_marks(rows: DataFrame, at: Column):
    """A broadcast bit map of MARKS bits with the bits at ``at`` set; gathered as at most MARKS / 32 integers."""
    words = rows.groupBy(F.shiftright(at, 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(31).cast("int"))).alias("bits"))
    out = np.zeros(MARKS // 32, dtype="<u4")
    for row in words.toLocalIterator():
        out[row["w"]] = row["bits"]
    return rows.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def keep_words(words: list[bytes], stretches) -> tuple[list[bytes], int]:
    """The words outside all stretches (start, end), and how many went."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for a, b in stretches:
        edge[a] += 1
        edge[b] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


def repeated_stretches(docs: DataFrame, *, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", word_bits: int = 64) -> DataFrame:
    """(rid, digest, stretches): for each document with something to remove, the word ranges (start, end) that go.

    rid is the id (``NO_ID`` for null) and digest the text's XXH64, together the key of a row's text.
    """
    spark = docs.sparkSession
    texts = docs.select(text_column(docs, text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rid"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = power_of_two(size / BYTES_A_COUNTER, LEAST_COUNTERS, MOST_COUNTERS)
    sketch = repeated_counters(texts.select("text"), width, counters, word_bits)
    held = None
    if counters <= MOST_BROADCAST:
        held = spark.sparkContext.broadcast(_gathered(sketch, counters))
        blocks = cut_lineage(texts.mapInArrow(_candidates(width, word_bits, held), _BLOCK))
    else:
        blocks = cut_lineage(_by_slice(texts.mapInArrow(_candidates(width, word_bits), _BLOCK), sketch, counters))

    same = lambda *pairs: reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in pairs])
    shared = blocks.groupBy(F.col("key1").alias("of1"), F.col("key2").alias("of2")).agg(F.min("rid").alias("least"), F.max("rid").alias("most"))
    shared = cut_lineage(shared.filter("least < most").select("of1", "of2", "least"))
    judged = cut_lineage(blocks.join(shared, same(("key1", "of1"), ("key2", "of2")), "left").withColumn("whole", F.coalesce(F.col("rid") > F.col("least"), F.lit(False))).drop("of1", "of2", "least"))
    first = judged.filter(~F.col("whole"))
    key = F.struct("key1", "key2")
    several = cut_lineage(first.groupBy(F.col("gram").alias("of")).agg(F.min(key).alias("a"), F.max(key).alias("b")).filter("a <> b").select("of"))
    unsure = first.join(several, F.col("gram") == F.col("of"), "left_semi")
    wanted = _gather_marks(unsure.select("mark"), F.col("mark"))

    single = cut_lineage(texts.mapInArrow(_candidates(width, word_bits, held, wanted), _WINDOWS))
    single = single.select("rid", "digest", "gram", F.posexplode("windows").alias("k", "window"), "start").select("rid", "digest", "gram", "window.*", (F.col("start") + F.col("k")).alias("start"))
    least = single.groupBy(F.col("gram").alias("of"), F.col("key1").alias("of1"), F.col("key2").alias("of2")).agg(F.min("rid").alias("least"), F.max("rid").alias("most"))
    least = cut_lineage(least.filter("least < most").select("of", "of1", "of2", "least"))
    found = single.join(least, same(("gram", "of"), ("key1", "of1"), ("key2", "of2"))).filter("rid > least")
    ranges = found.select("rid", "digest", "start", (F.col("start") + width).alias("end"))
    ranges = ranges.unionByName(judged.filter("whole").select("rid", "digest", "start", (F.col("start") + F.col("n") - 1 + width).alias("end")))
    return cut_lineage(ranges.groupBy("rid", "digest").agg(F.collect_set(F.struct("start", "end")).alias("stretches")))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row as if nothing were removed."""
    for batch in batches:
        digest = np.fromiter((_digest(t.as_py()) for t in batch.column(0)), dtype=np.uint64, count=batch.num_rows)
        n, sha = [], []
        for text in batch.column(0):
            words = words_of(text.as_py())
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), _signed(digest), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "rid", "digest", "n_words", "sha"])


def _marked(marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.schema.get_field_index("mark")).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(_is_set(marks.value, at)))

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid, digest, text, stretches = (batch.column(batch.schema.get_field_index(c)) for c in ("rid", "digest", "text", "stretches"))
        kept, n = [], []
        for t, ranges in zip(text, stretches, strict=True):
            words, gone = keep_words(words_of(t.as_py()), [(r["start"], r["end"]) for r in ranges.as_py()])
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            n.append(gone)
        yield pa.RecordBatch.from_arrays([rid, digest, pa.array(n, pa.int64()), pa.array(kept, pa.string())], names=["rid", "digest", "n_removed", "kept"])


def removed_texts(docs: DataFrame, stretches: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, digest, n_removed, kept) for the documents that lose something, one row per key; kept is the text left."""
    key = lambda r, d: F.xxhash64(r, d).bitwiseAND(F.lit(MARKS - 1).cast("long"))
    marks = _gather_marks(stretches.select(key("rid", "digest").alias("mark")), F.col("mark"))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rid"), F.coalesce(text_column(docs, text_col), F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    hit = texts.withColumn("mark", key("rid", "digest")).mapInArrow(_marked(marks), "rid long, text string, digest long, mark long")
    joined = hit.join(stretches.select(F.col("rid").alias("of_rid"), F.col("digest").alias("of"), "stretches"), (F.col("rid") == F.col("of_rid")) & (F.col("digest") == F.col("of")))
    return joined.select("rid", "digest", "text", "stretches").mapInArrow(_removed, "rid long, digest long, n_removed long, kept string")


def dedup_substrings(docs: DataFrame, *, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", word_bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row; ``removed_texts`` has the texts that changed."""
    stretches = repeated_stretches(docs, width=width, id_col=id_col, text_col=text_col, word_bits=word_bits)
    changed = removed_texts(docs, stretches, id_col=id_col, text_col=text_col)
    changed = cut_lineage(changed.select("rid", "digest", "n_removed", F.sha2("kept", 256).alias("kept_sha")).dropDuplicates(["rid", "digest"]))
    rows = docs.select(text_column(docs, text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rid"))
    rows = rows.mapInArrow(_whole, "doc_id long, rid long, digest long, n_words long, sha string")
    changed = changed.withColumnsRenamed({"rid": "of_rid", "digest": "of"})
    joined = rows.join(changed, (F.col("rid") == F.col("of_rid")) & (F.col("digest") == F.col("of")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))
