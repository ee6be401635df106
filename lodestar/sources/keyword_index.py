"""An inverted index over a chunk store: postings in blocks, looked up by lexeme, kept up to date bucket by bucket.

A posting says that a passage has a lexeme, and with what weight: ten for each place in the heading and one for each in the
text. The index is divided like the store, by file: what lies in one bucket of the store is a shard of the index. In a shard,
postings lie in folders by their lexeme's hash, sorted by lexeme, project and passage, in blocks of up to ``BLOCK`` postings: differences of
ids and weights in as few bytes as they need, with the block's first and last id and its largest weight.

``refresh`` brings an index up to a store's newest snapshot: only buckets whose part in the store has changed since are made
anew, so a file that is swapped costs its bucket. The index is a versioned table of its own; readers see one snapshot.

``search`` reads the folders of the lexemes that are asked for and no others. Blocks meet by shard; there every question's lists
are gone through from the rarest lexeme to the commonest. A passage first met in the i-th list can have n - i + 1 of the n
lexemes at most, so a block is opened only if that number, its largest weight and the largest weights of the lists after it
could reach the k-th best found so far; passages that are candidates are then looked up in the later lists by the blocks'
first and last ids. Results are those of ``operators.search.keyword_hits``, exactly.

A shard's blocks of the lexemes asked for are held by one task: a store's number of buckets is what bounds that.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.constants import CANDIDATES
from lodestar.functions.text import lexemes
from lodestar.operators.search import BROADCAST_TERMS, places, ranked
from lodestar.sources import versions

BLOCK = 128
LEXES = 16
#: Blocks opened before the k-th best is looked at again, and postings that are cheaper summed up than told apart.
AT_ONCE, SUMMED = 16, 1 << 17
_ROW = "bucket int, lex int, lexeme string, project int, n int, first long, last long, most long, steps binary, weights binary"
_SIZES = (np.uint8, np.uint16, np.uint32, np.uint64)
#: One lexeme more outweighs any sum of weights.
ONE_MORE = 1 << 40


def folder_of(word: str, lexes: int) -> int:
    """The same of a word at hand: Spark's hash is XXH64 of its UTF-8 with 42 as the seed, as a signed number."""
    value = xxhash.xxh64_intdigest(word.encode(), 42)
    return (value - (1 << 64) if value >> 63 else value) % lexes


def lex_of(lexeme: str, lexes: int):
    return F.pmod(F.xxhash64(lexeme), F.lit(lexes)).cast("int")


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers in the smallest size that holds them all, which the first byte names."""
    kind = next(k for k, t in enumerate(_SIZES) if k == 3 or int(numbers.max(initial=0)) <= np.iinfo(t).max)
    return bytes([kind]) + numbers.astype(_SIZES[kind]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=_SIZES[data[0]], offset=1)


def _cuts(columns: list[pa.Array]) -> list[int]:
    """Where rows that are equal in these columns begin, and the end of the last ones; nulls are equal."""
    n, other = len(columns[0]), np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        a, b = c.slice(0, n - 1), c.slice(1)
        apart = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        other |= apart | pc.not_equal(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(other) + 1).tolist(), n]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places sorted by (bucket, lex, lexeme, project, chunk) -> blocks; what one batch does not finish goes on in the next."""
    schema = pa.schema([("bucket", pa.int32()), ("lex", pa.int32()), ("lexeme", pa.string()), ("project", pa.int32()), ("n", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("most", pa.int64()), ("steps", pa.binary()), ("weights", pa.binary())])
    out: list[tuple] = []
    key, ids, weights = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def emit(final: bool) -> None:
        """Write whole blocks; the last one too if the list is over. A passage's places may go on in the next batch."""
        nonlocal ids, weights
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
        sums = np.add.reduceat(weights, starts) if len(ids) else weights
        found = ids[starts]
        done = len(found) if final else max(0, (len(found) - 1) // BLOCK * BLOCK)
        for a in range(0, done, BLOCK):
            c, w = found[a : min(a + BLOCK, done)], sums[a : min(a + BLOCK, done)]
            out.append((*key, len(c), int(c[0]), int(c[-1]), int(w.max()), _packed(np.diff(c).astype(np.uint64)), _packed(w)))
        ids, weights = (found[done:], sums[done:]) if len(ids) else (ids, weights)

    def rows() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
        out.clear()
        return made

    for batch in batches:
        if not batch.num_rows:
            continue
        chunk, w = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = _cuts([batch.column(i) for i in range(4)])
        keys = zip(*[batch.column(i).take(pa.array(cuts[:-1])).to_pylist() for i in range(4)], strict=True)
        for now, a, b in zip(keys, cuts[:-1], cuts[1:], strict=True):
            if now != key:
                if key is not None:
                    emit(True)
                key, ids, weights = now, np.zeros(0, np.int64), np.zeros(0, np.int64)
            ids, weights = np.r_[ids, chunk[a:b]], np.r_[weights, w[a:b]]
            if len(ids) > 4 * BLOCK:
                emit(False)
        if len(out) > 4_096:
            yield rows()
    if key is not None:
        emit(True)
    yield rows()


def _write(spark: SparkSession, chunks: DataFrame, path: str, buckets: int, lexed, lexes: int) -> None:
    """Blocks of these chunks (file_id, chunk, project, heading, text), under ``path``."""
    own = chunks.select(F.struct("chunk", "project", versions.bucket_of("file_id", buckets).alias("bucket")).alias("chunk"), "heading", "text")
    each = places(own, lexed).select("chunk.*", lex_of("lexeme", lexes).alias("lex"), "lexeme", F.col("w").cast("long").alias("w"))
    each = each.select("bucket", "lex", "lexeme", F.col("project").cast("int").alias("project"), F.col("chunk").cast("long").alias("chunk"), "w")
    dealt = each.repartition("bucket", "lex").sortWithinPartitions("bucket", "lex", "lexeme", "project", "chunk")
    dealt.mapInArrow(_blocks, _ROW).write.partitionBy("bucket", "lex").parquet(path)


def refresh(spark: SparkSession, store: str, index: str, *, model: str = versions.FIRST, lexed=lexemes, lexes: int = LEXES) -> versions.Snapshot:
    """Make the index say what the newest snapshot of the store says of this model's chunks; buckets that are as before stay.

    Chunks have file_id, chunk (a whole number, of one row), project, heading and text. ``lexes`` is that of a new index, and
    ``lexed`` must always be the same for one index.
    """
    while True:
        known = versions.latest(spark, store)
        parts = known.generation(model)["parts"]
        base = versions.latest(spark, index) or versions.new(index, "bucket", known.doc["buckets"])
        meta = {"lexes": lexes, "sources": {}} | base.meta(model)
        stale = [b for b, p in parts.items() if meta["sources"].get(b) != p]
        gone = [b for b in meta["sources"] if b not in parts]
        if base.version and not stale and not gone:
            return base
        part, made = f"parts/{uuid.uuid4().hex}", {}
        if stale:
            _write(spark, known.rows(spark, model, [int(b) for b in stale]), f"{index}/{part}", known.doc["buckets"], lexed, meta["lexes"])
            made = versions.parts_in(spark, index, part)

        def edit(doc: dict, stale: list = stale, gone: list = gone, made: dict = made, parts: dict = parts, meta: dict = meta) -> dict:
            g = doc["generations"].setdefault(model, {"parts": {}, "meta": {}, "schema": {}})
            g["parts"] = {b: p for b, p in g["parts"].items() if b not in stale and b not in gone} | made
            g["meta"] = meta | {"sources": dict(parts)}
            return doc | {"searched": model, "changed": {model: [int(b) for b in [*stale, *gone]]}, "changes": None}

        if (done := versions.commit(spark, base, edit)) is not None:
            return done
        if stale:
            versions.remove(spark, f"{index}/{part}")


def blocks(spark: SparkSession, snapshot: versions.Snapshot, lexes: Sequence[int], projects: Sequence[int] | None = None, model: str | None = None) -> DataFrame:
    """The blocks in the folders of these lexeme hashes, of these projects (None: of all)."""
    paths = [f"{snapshot.path}/{p}" for p in snapshot.generation(model)["parts"].values()]
    if not paths or not lexes or projects is not None and not projects:
        return spark.createDataFrame([], _ROW)
    rows = reduce(DataFrame.unionByName, [_shards(spark, snapshot.path, group) for group in _by_part(paths)]).where(F.col("lex").isin(*lexes))
    return rows if projects is None else rows.where(F.col("project").isin(*projects))


def _by_part(paths: Sequence[str]) -> list[list[str]]:
    found: dict[str, list[str]] = {}
    for p in paths:
        found.setdefault(p.rpartition("/")[0], []).append(p)
    return list(found.values())


def _shards(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    return spark.read.schema(_ROW).option("basePath", folders[0].rpartition("/")[0]).parquet(*folders)


class _List:
    """One lexeme's blocks in a shard and project, in order of passages; opened when they are needed."""

    def __init__(self, rows: list[tuple]):
        rows.sort(key=lambda r: r[1])
        self.n = sum(r[0] for r in rows)
        self.first, self.last, self.most = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2, 3))
        self.data, self.open = [(r[4], r[5]) for r in rows], {}
        self.top = int(self.most.max())
        self.every: tuple[np.ndarray, np.ndarray] | None = None

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if b not in self.open:
            steps, weights = self.data[b]
            self.open[b] = self.first[b] + np.r_[0, np.cumsum(_unpacked(steps).astype(np.int64))], _unpacked(weights).astype(np.int64)
        return self.open[b]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """All passages and their weights."""
        if self.every is None:
            opened = [self.block(b) for b in range(len(self.data))]
            self.every = np.concatenate([c for c, _ in opened]), np.concatenate([w for _, w in opened])
        return self.every

    def look_up(self, ids: np.ndarray) -> np.ndarray:
        """The weights of these passages (sorted), 0 where the lexeme is not."""
        out = np.zeros(len(ids), np.int64)
        at = np.searchsorted(self.first, ids, "right") - 1
        within = (at >= 0) & (ids <= self.last[at])
        for b in np.unique(at[within]).tolist():
            mine = np.flatnonzero(within & (at == b))
            c, w = self.block(b)
            k = np.minimum(np.searchsorted(c, ids[mine]), len(c) - 1)
            out[mine] = np.where(c[k] == ids[mine], w[k], 0)
        return out


def summed(lists: Sequence[_List]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, values) of all passages of these lists."""
    parts = [x.whole() for x in lists]
    ids = np.concatenate([c for c, _ in parts])
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], np.concatenate([w for _, w in parts])[order] + ONE_MORE
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return ids[starts], np.add.reduceat(values, starts)


def _kept(ids: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best and what equals the last of them; and its value."""
    if len(values) < k:
        return ids, values, 0
    least = int(np.partition(values, -k)[-k])
    good = values >= least
    return ids[good], values[good], least


def best(lists: Sequence[_List], k: int, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, values) of the k best passages of these lists and of those found already; equal values at the k-th place all stay.

    The rarest lists, of ``SUMMED`` postings together, are summed up; blocks of the others are opened as far as they can matter.
    """
    lists = sorted(lists, key=lambda x: x.n)
    after = np.cumsum([0, *[x.top for x in lists[::-1]]])[::-1]  # the largest weights of the lists from i on
    ids, values, least = _kept(*found, k)

    def completed(c: np.ndarray, value: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Passages and their values from the lists before ``start``: with those from there on, as long as they can matter."""
        for j in range(start, len(lists)):
            hope = value + (len(lists) - j) * ONE_MORE + after[j] >= least
            c, value = c[hope], value[hope]
            if not len(c):
                break
            w = lists[j].look_up(c)
            value = value + w + ONE_MORE * (w > 0)
        return c, value

    rare = int(np.searchsorted(np.cumsum([x.n for x in lists]), SUMMED, "right"))
    seen, value = summed(lists[:rare]) if rare else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    c, value = completed(seen, value, rare)
    ids, values, least = _kept(np.r_[ids, c], np.r_[values, value], k)
    for i, x in enumerate(lists[rare:], rare):
        bounds = (len(lists) - i) * ONE_MORE + x.most + after[i + 1]
        order = np.argsort(-bounds, kind="stable")
        for a in range(0, len(order), AT_ONCE):
            some = [b for b in order[a : a + AT_ONCE].tolist() if bounds[b] >= least]
            if not some:
                break
            c = np.concatenate([x.block(b)[0] for b in some])
            value = np.concatenate([x.block(b)[1] for b in some]) + ONE_MORE
            new = ~np.isin(c, seen)
            at = np.argsort(c[new])
            c, value = c[new][at], value[new][at]
            seen = np.concatenate([seen, c])
            c, value = completed(c, value, i + 1)
            ids, values, least = _kept(np.r_[ids, c], np.r_[values, value], k)
    return ids, values


def _searched(asked: list[tuple[object, list[str]]], k: int, kind: pa.DataType):
    """A shard's blocks -> its best passages for each question; ties at the k-th place are cut by the passage's id."""

    def run(shard: pa.Table) -> pa.Table:
        by: dict[str, dict[int, list[tuple]]] = {}
        names = ["lexeme", "project", "n", "first", "last", "most", "steps", "weights"]
        for lexeme, project, *rest in zip(*[shard[n].to_pylist() for n in names], strict=True):
            by.setdefault(lexeme, {}).setdefault(project, []).append(tuple(rest))
        lists = {w: {p: _List(rows) for p, rows in of.items()} for w, of in by.items()}
        sizes = {w: sum(x.n for x in of.values()) for w, of in lists.items()}
        out: list[tuple] = []
        for question, terms in asked:
            mine = [w for w in terms if w in lists]
            if not mine:
                continue
            if sum(sizes[w] for w in mine) <= SUMMED:
                found = _kept(*summed([x for w in mine for x in lists[w].values()]), k)[:2]
            else:  # a passage has one project, so projects are lists of their own
                found = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for project in {p for w in mine for p in lists[w]}:
                    found = best([lists[w][project] for w in mine if project in lists[w]], k, found)
            top = np.lexsort((found[0], -found[1]))[:k]
            out += [(question, int(c), int(v) // ONE_MORE / len(terms), int(v) % ONE_MORE / 10) for c, v in zip(found[0][top], found[1][top], strict=True)]
        types = [("question", kind), ("chunk", pa.int64()), ("score", pa.float64()), ("density", pa.float64())]
        return pa.table([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(types)], schema=pa.schema(types))

    return run


def search(spark: SparkSession, index: str | versions.Snapshot, questions: DataFrame, k: int = CANDIDATES, *, lexed=lexemes, projects: Sequence[int] | None = None, model: str | None = None, most: int = BROADCAST_TERMS) -> DataFrame:
    """(question, chunk, score, density, rank): as ``keyword_hits`` over the indexed passages, of these projects only.

    Up to ``most`` terms go along with the tasks; more questions are taken in blocks.
    """
    snapshot = versions.latest(spark, index) if isinstance(index, str) else index
    lexes = snapshot.meta(model)["lexes"]
    asked = questions.select("question", F.array_distinct(lexed(F.col("text"))).alias("terms")).where(F.size("terms") > 0)
    sizes = asked.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    parts = -(-sizes // most)
    kind = spark.createDataFrame([], questions.select("question").schema).toArrow().schema.field(0).type
    schema = f"question {questions.schema['question'].dataType.simpleString()}, chunk long, score double, density double"
    lists = []
    for part in range(parts):
        mine = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("question"), F.lit(parts)) == part)
        held = [(r["question"], r["terms"]) for r in mine.collect()]  # ``most`` terms, about
        words = sorted({w for _, terms in held for w in terms})
        met = blocks(spark, snapshot, sorted({folder_of(w, lexes) for w in words}), projects, model)
        met = met.join(F.broadcast(spark.createDataFrame(pa.table({"lexeme": words}))), "lexeme", "left_semi")
        lists.append(met.groupBy("bucket").applyInArrow(_searched(held, k, kind), schema))
    every = reduce(DataFrame.unionByName, lists) if lists else spark.createDataFrame([], schema)
    return ranked(every, k, F.col("score").desc(), F.col("density").desc())
