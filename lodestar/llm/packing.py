"""Best-two-fit packing of tokenized documents into sequences.

Packing looks at lengths only, and a length is one of ``capacity`` values. So the plan is made on the counts of each
length (at most ``capacity`` numbers, whatever the corpus size): fill a bin greedily with the longest documents that
fit; once nothing fits, replace its smallest document by the two unpacked ones that fill the widened gap most tightly;
use that filling as often as the counts allow. A plan is a few thousand fillings at most, each with a repetition count.

Documents find their place from the plan by their rank among those of the same length. Ranks are running counts over
(length, hash bucket), so a length that a third of all documents share is still many groups; the hash takes a row's number
in, so that one repeated row is many groups too. Which of the documents of a length goes where depends on how the table is
divided into partitions.

Defined results: null text is empty (one token, the end id); repeated rows and null ids are packed like any others;
an empty table gives an empty result; other columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.shared import cut_lineage, power_of_two, text_column
from lodestar.llm.vocabulary import encode

CAPACITY = 2_048
END_ID = 0
ROWS_A_BUCKET = 20_000


@dataclass(frozen=True)
class Plan:
    """Rows sorted by (length, rank): from this rank on, ``each`` documents of that length go into a sequence."""

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.length << 48 | self.rank, length << 48 | rank, side="right") - 1
        past = rank - self.rank[row]
        return self.sequence[row] + past // self.each[row], self.offset[row] + past % self.each[row] * length


def best_two(left: np.ndarray, gap: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum within the gap."""
    lengths = np.flatnonzero(left[: gap + 1])
    if not len(lengths):
        return None
    fits = np.searchsorted(lengths, gap - lengths, side="right") - 1
    other = np.where(fits >= 0, lengths[np.maximum(fits, 0)], 0)
    twice = (other == lengths) & (left[lengths] < 2)
    other = np.where(twice, np.where(fits > 0, lengths[np.maximum(fits - 1, 0)], 0), other)
    total = np.where(other > 0, lengths + other, 0)
    at = int(np.argmax(total))
    return (int(lengths[at]), int(other[at])) if total[at] else None


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """counts: number of documents of each length from 1 to capacity."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    done, rows, sequence = np.zeros_like(left), [], 0
    while left.any():
        filling: dict[int, int] = {}
        gap = capacity
        while gap:
            fitting = np.flatnonzero(left[: gap + 1])
            if not len(fitting):
                break
            longest = int(fitting[-1])
            n = min(gap // longest, int(left[longest]))
            filling[longest] = filling.get(longest, 0) + n
            left[longest] -= n
            gap -= n * longest
        smallest = min(filling)
        if gap and (two := best_two(left, gap + smallest)) and sum(two) > smallest:
            filling[smallest] -= 1
            left[smallest] += 1
            for x in two:
                filling[x] = filling.get(x, 0) + 1
                left[x] -= 1
        filling = {x: n for x, n in filling.items() if n}
        for x, n in filling.items():
            left[x] += n
        times = min(int(left[x]) // n for x, n in filling.items())
        offset = 0
        for x, n in sorted(filling.items(), reverse=True):
            rows.append((x, int(done[x]), n, sequence, offset))
            left[x] -= n * times
            done[x] += n * times
            offset += n * x
        sequence += times
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=sequence)


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; one that is cut has its shorter piece first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(at, capacity) for at in range(first, n, capacity)]


def _pieces(capacity: int, path: str, pattern: str, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(0)):
                ids = np.append(encode(text.as_py(), path, pattern), np.array([end_id], dtype="<u4"))
                for k, (at, n) in enumerate(cut_pieces(len(ids), capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                    if with_ids:
                        kept.append(ids[at : at + n].astype(np.int32))
            out = [batch.column(1).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["row", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out, names = [*out, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _place(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            sequence, offset = plan.place(batch.column(at("length")).to_numpy(), batch.column(at("rank")).to_numpy())
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(at(n)) for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack_documents(
    docs: DataFrame,
    *,
    path: str,
    pattern: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: the ``keep`` columns, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    ``path`` names a byte-level BPE vocabulary on every executor, ``pattern`` its pre-tokenizer's expression.
    """
    made = T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
    rows = docs.select(text_column(docs, text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    schema = T.StructType([rows.schema["row"], *made])
    pieces = rows.mapInArrow(_pieces(capacity, path, pattern, end_id, with_ids), schema)
    pieces = cut_lineage(pieces.withColumn("key", F.xxhash64("row", "piece", F.monotonically_increasing_id())))
    buckets = power_of_two(pieces.count() / ROWS_A_BUCKET, 256, 1 << 20)
    pieces = pieces.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    counts = cut_lineage(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    plan = make_plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("length").alias("of_length"), F.col("bucket").alias("of_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    order = Window.partitionBy("length", "bucket").orderBy("key", "row", "piece", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(order)).join(offsets, (F.col("length") == F.col("of_length")) & (F.col("bucket") == F.col("of_bucket")))
    ranked = ranked.select("row", *made.names, (F.col("earlier") + F.col("nth") - 1).alias("rank"))
    placed = ranked.mapInArrow(_place(plan), T.StructType([rows.schema["row"], *made, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    return placed.select(*[F.col("row").getField(c).alias(c) for c in keep], *made.names, "sequence_id", "offset")
