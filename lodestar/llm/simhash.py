"""SimHash near-duplicates by anchor-point covering.

Fingerprints: every document's three-word shingles are hashed (XXH64, seed 42) and vote per bit.

Links (at most ``THRESHOLD`` = 3 of 64 bits differ): of two fingerprints within 3, one half of 32 bits differs in at
most one bit. The anchors of a half are the words of the Hamming code on its first 31 bits, a perfect code with covering
radius 1. A fingerprint is replicated to every anchor within covering radius plus the half's threshold, 1 + 1 = 2: its
own anchor, and the 15 at distance two. Two halves within one bit of each other therefore meet at the own anchor of
either (or agree in all 31 bits), and are compared there on all 64 bits. That is 32 narrow rows for each *distinct*
fingerprint, whatever the corpus size; copies are folded before.

A group at an anchor is never gathered whole if it is large: anchors that may hold more than ``MOST_AT_ANCHOR``
fingerprints (found by exact counts behind a hashed count that can only be too high) deal theirs into slices, and every
pair of slices is compared on its own. A comparison returns for each fingerprint the least one of its group that it is
connected to, not the pairs.

Defined results: null and empty texts have fingerprint zero, linked like any other; null ids are not candidates for a
component's smallest id (a component without any id has a null one); repeated rows each give a row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.components import label_components
from lodestar.llm.shared import cut_lineage, power_of_two, text_column

THRESHOLD = 3
SHINGLE = 3
SEED = 42
MOST_AT_ANCHOR = 8_192
#: Bits of a position (1 to 31) that enter each of the five checks of the Hamming code.
CHECKS = [sum(1 << (i - 1) for i in range(1, 32) if i >> c & 1) for c in range(5)]
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SLICE = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), _SLICE):
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles[at : at + _SLICE]), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(shingles), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of every row, as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def anchors(fp: Column) -> Column:
    """Keys of all anchors of both halves within distance two, as an array.

    The five checks of the Hamming code give a half's syndrome s: the position to flip to reach its own anchor (0: it is
    one). Anchors at distance two flip a pair of positions i < j whose numbers combine to s (i xor j = s).
    """
    def bit(position: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), position - 1)

    def of_half(k: int) -> Column:
        half = F.shiftrightunsigned(fp, 32 * k).bitwiseAND(F.lit((1 << 31) - 1).cast("long"))
        checks = [F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(m).cast("long"))).bitwiseAND(F.lit(1)), c) for c, m in enumerate(CHECKS)]

        def near(h: Column) -> Column:
            x, s = h["x"], h["s"]
            pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: (s > 0) & (i != s) & (i < i.bitwiseXOR(s)))
            two = F.transform(pairs, lambda i: x.bitwiseXOR(bit(i)).bitwiseXOR(bit(i.bitwiseXOR(s))))
            own = F.when(s == 0, x).otherwise(x.bitwiseXOR(bit(F.greatest(s, F.lit(1)))))
            return F.transform(F.concat(F.array(own), two), lambda a: a.bitwiseOR(F.lit(k << 32).cast("long")))

        return F.element_at(F.transform(F.array(F.struct(half.alias("x"), sum(checks[1:], checks[0]).alias("s"))), near), 1)

    return F.concat(of_half(0), of_half(1))


def _forest(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted fingerprints -> (fingerprint, least one connected to it within the group), least ones left out."""
    n = len(group)
    label = np.full(n, -1, dtype=np.int64)
    for root in range(n):
        if label[root] >= 0:
            continue
        label[root] = root
        front = np.array([root])
        while len(front):
            free = np.flatnonzero(label < 0)
            if not len(free):
                break
            found = np.zeros(len(free), dtype=bool)
            step = max(1, 4_000_000 // len(free))
            for at in range(0, len(front), step):
                near = np.bitwise_count(group[front[at : at + step], None] ^ group[None, free]) <= THRESHOLD
                found |= near.any(axis=0)
            front = free[found]
            label[front] = root
    members = np.flatnonzero(label != np.arange(n))
    return group[members], group[label[members]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, fp), sorted; one group after another, with the end of a batch carried into the next."""
    def emit(key: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        sizes = np.diff(np.r_[new, len(key)])
        a, b = [], []
        pairs = new[sizes == 2]
        if len(pairs):
            near = pairs[(np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= THRESHOLD) & (fp[pairs] != fp[pairs + 1])]
            a.append(fp[near + 1])
            b.append(fp[near])
        for at, size in zip(new[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            x, y = _forest(np.unique(fp[at : at + size]))
            a.append(x)
            b.append(y)
        if not a or not sum(map(len, a)):
            return None
        edges = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, k]).view(np.int64)) for k in (0, 1)], names=["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        last = len(now[0]) - 1
        differs = np.flatnonzero((now[0] != now[0][last]) | (now[1] != now[1][last]))
        cut = differs[-1] + 1 if len(differs) else 0
        held = [x[cut:] for x in now]
        if cut and (out := emit(*[x[:cut] for x in now])) is not None:
            yield out
    if held is not None and (out := emit(*held)) is not None:
        yield out


def _slices(placed: DataFrame, n: int | None = None) -> DataFrame:
    """(fp, key) -> (key, part, fp): rows of crowded anchors go to every pair of slices that theirs is in; ``n`` if it is known."""
    n = placed.count() if n is None else n
    cells = power_of_two(8 * n / MOST_AT_ANCHOR, 1 << 14, 1 << 40)
    cell = F.pmod(F.xxhash64("key"), F.lit(cells))
    crowded = cut_lineage(placed.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).filter(F.col("n") > MOST_AT_ANCHOR).select("cell"))
    if crowded.isEmpty():
        return placed.select("key", F.lit(0).alias("part"), "fp")
    counts = placed.withColumn("cell", cell).join(crowded, "cell", "left_semi").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_AT_ANCHOR)
    counts = cut_lineage(counts.select("key", F.ceil(2 * F.col("n") / MOST_AT_ANCHOR).cast("int").alias("slices")))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("slices")).cast("int")
    parts = F.when(F.col("slices").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: F.least(s, own) * F.col("slices") + F.greatest(s, own)))
    return placed.join(counts, "key", "left").select("key", F.explode(parts).alias("part"), "fp")


def near_links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect exactly those that chains of near pairs connect."""
    placed = prints.select("fp", F.explode(anchors(F.col("fp"))).alias("key"))
    rows = _slices(placed)
    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "fp").select("key", "part", "fp").mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, component) for every row; component_id is the smallest id that chains of links reach.

    ``component`` is the component's least fingerprint: it tells components apart also where ids repeat or are null.
    """
    return _join_components(cut_lineage(fingerprints(docs, id_col, text_col)))


def _join_components(marked: DataFrame) -> DataFrame:
    folded = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = label_components(cut_lineage(near_links(folded.select("fp"))))
    linked = cut_lineage(found.join(folded, F.col("node") == F.col("fp")).select("fp", "component", "least"))
    ids = cut_lineage(linked.groupBy(F.col("component").alias("of")).agg(F.min("least").alias("component_id")))
    linked = linked.join(ids, F.col("component") == F.col("of")).select(F.col("fp").alias("of_fp"), "component", "component_id")
    named = folded.join(linked, F.col("fp") == F.col("of_fp"), "left")
    named = cut_lineage(named.select("fp", F.coalesce("component", "fp").alias("component"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")))
    named = named.withColumnRenamed("fp", "of_fp")
    return marked.join(named, F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "component_id", "component")
