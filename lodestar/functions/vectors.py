"""Vectors: cosine similarity and the hashed bag-of-words embedding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile("[a-z0-9]{3,}")
#: Words that a worker remembers, and texts of which it makes one message.
MOST_REMEMBERED, TEXTS_AT_ONCE = 100_000, 1_000
DIGITS = 9
MATRIX_BYTES, ROWS_A_TASK = 32 << 20, 1_000_000

#: Longer expressions are neither compiled nor planned well.
FLAT_DIM = 128


def hashed_counts(rows: DataFrame, id_col: str, text_col: str, dim: int) -> DataFrame:
    """(id, counts): how many words of three letters or more fall into each bucket; a text without any has one in 0.

    A bucket is the word's MD5, as a 128-bit number, modulo ``dim``. Every text is counted in its own row, over Arrow
    batches: no word is shuffled, and a worker hashes a word once while it remembers it.
    """
    slim = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_count(dim), T.StructType([slim.schema["id"], T.StructField("counts", T.ArrayType(T.DoubleType()))]))


def with_counts(rows: DataFrame, dim: int, **texts: str) -> DataFrame:
    """The rows with a column of counts for each text column that is named (counts="text"), without a join."""
    slim = rows.select(F.struct(*rows.columns).alias("row"))
    schema = T.StructType([slim.schema["row"], *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in texts]])
    places = [rows.columns.index(c) for c in texts.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(dim)
        for batch in _pieces(batches):
            row = batch.column(0)
            yield pa.RecordBatch.from_arrays([row, *[count(row.field(i).cast(pa.string())) for i in places]], names=["row", *texts])

    return slim.mapInArrow(run, schema).select("row.*", *texts)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``TEXTS_AT_ONCE`` rows at most: what is made of a batch is in memory beside it."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(at, TEXTS_AT_ONCE)


def _counter(dim: int):
    """From a column of texts to its counts; words are remembered from one batch to the next."""
    known: dict[str, int] = {}

    def bucket(word: str) -> int:
        if len(known) > MOST_REMEMBERED:
            known.clear()
        found = known[word] = int(hashlib.md5(word.encode()).hexdigest(), 16) % dim
        return found

    def count(texts: pa.Array) -> pa.Array:
        counts = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            at = [known[w] if w in known else bucket(w) for w in WORD.findall((text.as_py() or "").lower())]
            counts[i] = np.bincount(at, minlength=dim) if at else 0
            counts[i, 0] += not at
        return pa.FixedSizeListArray.from_arrays(pa.array(counts.ravel()), dim).cast(pa.list_(pa.float64()))

    return count


def _count(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(dim)
        for batch in _pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), count(batch.column(1))], names=["id", "counts"])

    return run


def nearest(rows: DataFrame, key: str, questions: DataFrame, dim: int, k: int) -> DataFrame:
    """(question, key, sim): candidates for each question's k rows of largest cosine similarity, ties to the smaller key.

    ``rows`` has key and counts, ``questions`` question and counts. A batch of rows is multiplied with questions that are in
    memory, tile by tile (``TILE_NUMBERS``), and a task keeps the k best it has seen for each of them: what leaves a task is
    k rows a question, once. Questions of ``MATRIX_BYTES`` go along with the task; more are dealt into blocks of that size, which
    meet all rows block by block. Similarities have nine digits, so that equal ones tie, and are null where a vector is null
    or has no length; those rank last.
    """
    size = questions.count() * dim * 8
    slim = rows.select(F.col(key).alias("key"), F.col("counts").cast("array<double>").alias("counts"))
    schema = T.StructType([questions.schema["question"], T.StructField(key, slim.schema["key"].dataType), T.StructField("sim", T.DoubleType())])
    if size <= MATRIX_BYTES:
        held = questions.select("question", F.col("counts").cast("array<double>").alias("counts")).toArrow()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(held["question"].combine_chunks(), held["counts"], key, dim, k)
            for batch in batches:
                best.meet(batch.column(0), batch.column(1))
            yield from best.found()

        return slim.mapInArrow(run, schema)
    blocks, parts = -(-size // MATRIX_BYTES), max(1, rows.count() // ROWS_A_TASK)
    none = lambda of, name: F.lit(None).cast(of.schema[name].dataType).alias(name)
    asked = questions.select(F.pmod(F.xxhash64("question"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(False).alias("is_row"), "question", none(slim, "key"), F.col("counts").cast("array<double>").alias("counts"))
    data = slim.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("is_row"), none(questions, "question"), "key", "counts")
    dealt = asked.unionByName(data).repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part", "is_row")
    return dealt.mapInArrow(_nearest_blocks(key, dim, k), schema)


def _matrix(column, dim: int) -> np.ndarray:
    """Vectors as rows; null ones, and those of another size, are zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, dim))
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    numbers = pc.fill_null(column.filter(right).flatten(), float("nan")).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    out[right.to_numpy(zero_copy_only=False)] = numbers.reshape(-1, dim)
    return out


#: Numbers of one product of questions and rows, and of one message of results.
TILE_NUMBERS, ROWS_AT_ONCE = 1 << 18, 1 << 16
#: Stands for no similarity: below all others.
_NONE = -2.0


class Best:
    """The k best rows met so far for each question; memory is that of the questions, of k rows for each, and of a tile."""

    def __init__(self, ids: pa.Array, counts, key: str, dim: int, k: int):
        self.ids, self.key, self.dim, self.k = ids, key, dim, k
        self.q = _matrix(counts, dim)
        self.lengths = np.sqrt((self.q**2).sum(axis=1))
        self.sims = np.full((len(ids), k), -np.inf)  # -inf: no row yet
        self.at = np.zeros((len(ids), k), np.int64)  # place of the row's key in ``keys``
        self.keys: pa.Array | None = None

    def meet(self, keys: pa.Array, vectors) -> None:
        if not len(keys) or not len(self.ids):
            return
        order = pc.sort_indices(keys)
        keys, x = keys.take(order), _matrix(vectors, self.dim)[order.to_numpy()]
        row_lengths = np.sqrt((x**2).sum(axis=1))
        held = 0 if self.keys is None else len(self.keys)
        known = keys if self.keys is None else pa.concat_arrays([self.keys, keys])
        rank = np.empty(len(known), np.int64)  # of all keys at hand, so that ties can be told
        rank[pc.sort_indices(known).to_numpy()] = np.arange(len(known))
        step = max(1, TILE_NUMBERS // len(keys))
        for a in range(0, len(self.ids), step):
            mine = slice(a, a + step)
            lengths = self.lengths[mine, None] * row_lengths
            with np.errstate(divide="ignore", invalid="ignore"):
                sim = np.where(lengths > 0, np.round(self.q[mine] @ x.T / lengths, DIGITS), _NONE)
            at, sim = self._top(sim)
            at, sim = np.hstack([self.at[mine], at + held]), np.hstack([self.sims[mine], sim])
            best = np.lexsort((rank[at], -sim), axis=1)[:, : self.k]
            self.at[mine], self.sims[mine] = np.take_along_axis(at, best, axis=1), np.take_along_axis(sim, best, axis=1)
        used = np.unique(self.at[np.isfinite(self.sims)])
        self.keys, self.at = known.take(pa.array(used)), np.minimum(np.searchsorted(used, self.at), max(0, len(used) - 1))

    def _top(self, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the k largest of each row; of equal ones at the k-th place the first."""
        n, k = sim.shape[1], self.k
        if n <= k:
            return np.broadcast_to(np.arange(n), sim.shape), sim
        least = np.partition(sim, n - k, axis=1)[:, n - k, None]
        above, equal = sim > least, sim == least
        chosen = above | equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))
        at = np.nonzero(chosen)[1].reshape(len(sim), k)
        return at, np.take_along_axis(sim, at, axis=1)

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.keys is None:
            return
        asked, place = np.nonzero(np.isfinite(self.sims))
        for a in range(0, len(asked), ROWS_AT_ONCE):
            i, j = asked[a : a + ROWS_AT_ONCE], place[a : a + ROWS_AT_ONCE]
            sim = self.sims[i, j]
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(i)), self.keys.take(pa.array(self.at[i, j])), pa.array(sim, mask=sim == _NONE)], names=["question", self.key, "sim"])


def _nearest_blocks(key: str, dim: int, k: int):
    """Rows sorted by (block, part, is_row): a block's questions, then the rows that meet them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, questions, best = None, [], None
        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            cuts = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in keys], axis=0)]).tolist() if batch.num_rows else []
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if (here := (keys[0][a], keys[1][a])) != now:
                    if best is not None:
                        yield from best.found()
                    now, questions, best = here, [], None
                if not keys[2][a]:
                    questions.append(part)
                elif questions:
                    if best is None:
                        table = pa.Table.from_batches(questions)
                        best = Best(table["question"].combine_chunks(), table["counts"], key, dim, k)
                    best.meet(part.column(4), part.column(5))
        if best is not None:
            yield from best.found()

    return run


def unit(counts: Column) -> Column:
    """The vector divided by its length."""
    return F.transform(F.array(norm(counts)), lambda n: F.transform(counts, lambda x: x / n))[0]


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column, dim: int) -> Column:
    """An inner product; of few dimensions as one flat expression, which is compiled with the stage it is in."""
    if dim > FLAT_DIM:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    out = a[0].cast("double") * b[0].cast("double")
    for i in range(1, dim):
        out = out + a[i].cast("double") * b[i].cast("double")
    return out
