"""A graph index over the vectors of a chunk store: near rows are linked, a search walks towards a question.

The index is divided like the store, by file: what lies in one bucket of the store is a shard with a graph of its own, built by
one task and searched by one task, all shards beside each other. ``refresh`` builds anew only the shards whose part in the store has
changed. Every row of a shard is in its graph; rows without a length (null, or all zeros) have no cosine and are not found.

A row is linked to its nearest rows in the shard, as far as no row that it is linked to already is nearer to that one than the row
itself (so links go in different directions), to those that are linked to it, and to a few rows drawn by a fixed seed, over which a
walk gets from one cluster to another. A search starts from some spread rows, keeps the ``beam`` best rows seen and follows the links of the best
one not followed yet until none is left.

Under a filter by project a walk goes over all rows and collects those of the projects, with a beam that is larger by as much as
the filter lets fewer rows pass. It is repeated with twice the size where it has found too few, and a shard in which few rows pass
is compared row by row, so a filter costs no results.

Rows that point the same way are one node of the graph, linked once and found together, so many copies of a vector neither fill a row's links nor
hide what lies around them.

Similarities are those of ``functions.vectors.nearest``. Which rows are found is approximate: the beam decides; ``exact=True`` compares all rows of the
same index instead. A shard is held by one task: a store's number of buckets is what bounds it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.constants import CANDIDATES
from lodestar.functions.vectors import DIGITS, MATRIX_BYTES
from lodestar.operators.search import ranked
from lodestar.sources import versions

LINKS, NEAR, LONG, STARTS, BEAM = 16, 48, 4, 512, 320
#: Rows compared with all others at once, and questions that walk together.
TILE, TOGETHER = 512, 128
#: Under a filter, so many passing rows for each place of the beam are compared one by one; a walk would see about as many.
ONE_BY_ONE = 16
_ROW = "chunk long, project int, vector binary, links binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("project", pa.int32()), ("vector", pa.binary()), ("links", pa.binary())])


def _units(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x**2).sum(axis=1, keepdims=True))).astype(np.float32)


def nodes_of(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct unit vector, in order, and for every row which of these it equals."""
    whole = np.ascontiguousarray(units + 0).view(np.dtype((np.void, units.shape[1] * units.itemsize))).ravel()
    _, first, which = np.unique(whole, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return first[order], place[which]


def graph_of(units: np.ndarray, links: int = LINKS, near: int = NEAR) -> list[np.ndarray]:
    """For each row the rows it is linked to."""
    n = len(units)
    out: list[list[int]] = [[] for _ in range(n)]
    for a in range(0, n, TILE):
        mine = np.arange(a, min(a + TILE, n))
        sim = units[mine] @ units.T
        sim[np.arange(len(mine)), mine] = -np.inf
        m = min(near, n - 1)
        if not m:
            continue
        top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
        value = np.take_along_axis(sim, top, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        top, value = np.take_along_axis(top, order, axis=1), np.take_along_axis(value, order, axis=1)
        between = np.einsum("rid,rjd->rij", units[top], units[top])
        kept = np.zeros(top.shape, bool)
        for c in range(m):  # a candidate stays unless a kept one is nearer to it than the row is
            hidden = (kept[:, :c] & (between[:, :c, c] > value[:, c, None])).any(axis=1)
            kept[:, c] = ~hidden & (kept.sum(axis=1) < links)
        kept[:, : min(4, m)] = True  # dense spots: the very nearest stay whatever hides them
        for i, row in enumerate(mine.tolist()):
            out[row] = top[i][kept[i]].tolist()
    drawn = np.random.default_rng(n).integers(0, n, (n, LONG))
    back: list[list[int]] = [[] for _ in range(n)]
    for i, found in enumerate(out):
        for j in found:
            if len(back[j]) < 2 * links:
                back[j].append(i)
    return [np.array(sorted({*out[i], *back[i], *drawn[i].tolist()} - {i}), dtype=np.int32) for i in range(n)]


def _built(shard: pa.Table) -> pa.Table:
    """A shard's rows (bucket, chunk, project, vector) -> the same with links between nodes, held by the first row of each."""
    shard = shard.sort_by("chunk")
    vectors = [None if v is None else np.array(v, dtype=np.float64) for v in shard["vector"].to_pylist()]
    held = [i for i, v in enumerate(vectors) if v is not None and np.isfinite(v).all() and v.any()]
    links: list[bytes | None] = [None] * len(vectors)
    if held:
        units = _units(np.stack([vectors[i] for i in held]))
        first, _ = nodes_of(units)
        for at in held:
            links[at] = b""
        for at, found in zip(first.tolist(), graph_of(units[first]), strict=True):
            links[held[at]] = found.tobytes()
    data = [v.tobytes() if k is not None else None for v, k in zip(vectors, links, strict=True)]
    return pa.table([shard["bucket"], shard["chunk"], shard["project"], pa.array(data, pa.binary()), pa.array(links, pa.binary())], schema=_SCHEMA)


def refresh(spark: SparkSession, store: str, index: str, *, model: str = versions.FIRST, vector: str = "counts") -> versions.Snapshot:
    """Make the index cover the newest snapshot of the store's chunks (file_id, chunk, project, vector); shards that are as before stay."""
    while True:
        known = versions.latest(spark, store)
        parts = known.generation(model)["parts"]
        base = versions.latest(spark, index) or versions.new(index, "bucket", known.doc["buckets"])
        meta = {"sources": {}} | base.meta(model)
        stale = [b for b, p in parts.items() if meta["sources"].get(b) != p]
        gone = [b for b in meta["sources"] if b not in parts]
        if base.version and not stale and not gone:
            return base
        part, made = f"parts/{uuid.uuid4().hex}", {}
        if stale:
            rows = known.rows(spark, model, [int(b) for b in stale])
            rows = rows.select(versions.bucket_of("file_id", known.doc["buckets"]).alias("bucket"), F.col("chunk").cast("long").alias("chunk"), F.col("project").cast("int").alias("project"), F.col(vector).cast("array<double>").alias("vector"))
            rows.groupBy("bucket").applyInArrow(_built, f"bucket int, {_ROW}").write.partitionBy("bucket").parquet(f"{index}/{part}")
            made = versions.parts_in(spark, index, part)

        def edit(doc: dict, stale: list = stale, gone: list = gone, made: dict = made, parts: dict = parts) -> dict:
            g = doc["generations"].setdefault(model, {"parts": {}, "meta": {}, "schema": {}})
            g["parts"] = {b: p for b, p in g["parts"].items() if b not in stale and b not in gone} | made
            g["meta"] = {"sources": dict(parts)}
            return doc | {"searched": model, "changed": {model: [int(b) for b in [*stale, *gone]]}, "changes": None}

        if (done := versions.commit(spark, base, edit)) is not None:
            return done
        if stale:
            versions.remove(spark, f"{index}/{part}")


def rows(spark: SparkSession, snapshot: versions.Snapshot, model: str | None = None) -> DataFrame:
    """All rows of the index with their shard."""
    paths = [(int(b), f"{snapshot.path}/{p}") for b, p in snapshot.generation(model)["parts"].items()]
    frame = spark.createDataFrame([], f"bucket int, {_ROW}")
    by_part: dict[str, list[str]] = {}
    for _, p in paths:
        by_part.setdefault(p.rpartition("/")[0], []).append(p)
    for base, folders in by_part.items():
        frame = frame.unionByName(spark.read.schema(f"{_ROW}, bucket int").option("basePath", base).parquet(*folders))
    return frame


class Shard:
    """The graph of a shard in memory."""

    def __init__(self, chunks: np.ndarray, projects: np.ndarray | None, vectors: np.ndarray, links: list[np.ndarray]):
        self.chunks, self.projects, self.vectors, self.units = chunks, projects, vectors, _units(vectors)
        self.links = np.full((len(links), max(1, *map(len, links)) if len(links) > 1 else 1), -1, np.int32)
        for i, found in enumerate(links):
            self.links[i, : len(found)] = found
        self.starts = np.unique(np.linspace(0, len(chunks) - 1, min(STARTS, len(chunks))).astype(np.int64))
        self.opened = 0

    def walk(self, questions: np.ndarray, passing: np.ndarray, k: int, beam: int) -> np.ndarray:
        """The places of the k best passing rows that each of these questions (unit vectors) sees; -1 where there are fewer."""
        n, q = len(self.chunks), len(questions)
        seen = np.zeros((q, n), bool)
        who, step = np.arange(q)[:, None], max(4, beam // 32)
        seen[:, self.starts] = True
        ids, sims = np.broadcast_to(self.starts, (q, len(self.starts))), questions @ self.units[self.starts].T
        followed = np.zeros(ids.shape, bool)
        best, best_sims = np.where(passing[ids], ids, -1), np.where(passing[ids], sims, -np.inf)
        self.opened += ids.size
        while True:
            keep = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims, followed = (np.take_along_axis(x, keep, axis=1) for x in (ids, sims, followed))
            keep = np.argsort(-best_sims, axis=1, kind="stable")[:, :k]
            best, best_sims = (np.take_along_axis(x, keep, axis=1) for x in (best, best_sims))
            waiting = np.where(followed | np.isneginf(sims), np.inf, np.arange(ids.shape[1]))  # rows are in order of similarity
            at = np.argsort(waiting, axis=1, kind="stable")[:, :step]
            live = np.isfinite(np.take_along_axis(waiting, at, axis=1))
            if not live.any():
                return best
            followed[who, at] |= live
            new = np.where(live[:, :, None], self.links[np.take_along_axis(ids, at, axis=1)], -1).reshape(q, -1)
            new.sort(axis=1)
            fresh = (new >= 0) & ~seen[who, np.maximum(new, 0)]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            width = int(fresh.sum(axis=1).max(initial=0))
            if not width:
                continue
            pick = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
            new, fresh = np.take_along_axis(new, pick, axis=1), np.take_along_axis(fresh, pick, axis=1)
            new = np.where(fresh, new, 0)
            seen[np.broadcast_to(who, new.shape)[fresh], new[fresh]] = True
            value = np.where(fresh, np.einsum("qd,qmd->qm", questions, self.units[new]), -np.inf)
            self.opened += int(fresh.sum())
            ids, sims, followed = np.hstack([ids, new]), np.hstack([sims, value]), np.hstack([followed, np.zeros(new.shape, bool)])
            good = fresh & passing[new]
            best, best_sims = np.hstack([best, np.where(good, new, -1)]), np.hstack([best_sims, np.where(good, value, -np.inf)])

    def found(self, questions: np.ndarray, passing: np.ndarray, k: int, beam: int, exact: bool) -> list[np.ndarray]:
        """For each question the places of its rows: more than k where all are compared."""
        n_passing = int(passing.sum())
        everyone = np.flatnonzero(passing)
        if exact or n_passing <= beam or n_passing < len(self.chunks) and n_passing <= ONE_BY_ONE * beam:
            return [everyone] * len(questions)
        out: list[np.ndarray] = [everyone] * len(questions)
        open_questions, size = np.arange(len(questions)), max(k, beam * len(self.chunks) // n_passing)
        while len(open_questions) and size < len(self.chunks):
            few = []
            for a in range(0, len(open_questions), TOGETHER):
                some = open_questions[a : a + TOGETHER]
                for i, places in zip(some.tolist(), self.walk(questions[some], passing, k, size), strict=True):
                    places = places[places >= 0]
                    if len(places) >= min(k, n_passing):
                        out[i] = places
                    else:
                        few.append(i)
            open_questions, size = np.array(few, dtype=np.int64), 2 * size
        return out


def _search(asked: pa.Table, k: int, beam: int, projects: Sequence[int] | None, exact: bool):
    def run(shard: pa.Table) -> pa.Table:
        types = pa.schema([("question", asked.schema.field(0).type), ("chunk", pa.int64()), ("score", pa.float64())])
        shard = shard.filter(pa.compute.is_valid(shard["links"])).sort_by("chunk")
        if not len(shard) or not len(asked):
            return types.empty_table()
        vectors = np.stack([np.frombuffer(v.as_py(), dtype=np.float64) for v in shard["vector"]])
        chunks = shard["chunk"].to_numpy()
        passing = np.ones(len(vectors), bool) if projects is None else np.isin(shard["project"].to_numpy(zero_copy_only=False), list(projects))
        first, which = nodes_of(_units(vectors))
        links = [np.frombuffer(shard["links"][i].as_py(), dtype=np.int32) for i in first.tolist()]
        here = Shard(chunks[first], None, vectors[first], links)
        # Of each node the rows that pass, k at most: the smaller ids, as ties are cut.
        copies = np.flatnonzero(passing)
        copies = copies[np.argsort(which[copies], kind="stable")]
        starts = np.searchsorted(which[copies], np.arange(len(first) + 1))
        rows_of = [copies[a : min(b, a + k)] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        passing = starts[1:] > starts[:-1]
        lengths = np.sqrt((vectors**2).sum(axis=1))
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        q = np.array(asked["counts"].to_pylist(), dtype=np.float64).reshape(len(asked), -1)
        q_lengths = np.sqrt((q**2).sum(axis=1))
        whole = np.flatnonzero(q_lengths > 0)
        for i, places in zip(whole.tolist(), here.found(_units(q[whole]), passing, k, beam, exact) if len(whole) else [], strict=True):
            places = np.concatenate([rows_of[n] for n in places.tolist()]) if len(places) else places
            sim = np.round(vectors[places] @ q[i] / (lengths[places] * q_lengths[i]), DIGITS)
            top = np.lexsort((chunks[places], -sim))[:k]
            out.append((i, chunks[places][top], sim[top]))
        if not out:
            return types.empty_table()
        question = asked.column(0).combine_chunks().take(pa.array(np.repeat([i for i, _, _ in out], [len(c) for _, c, _ in out])))
        return pa.table([question, pa.array(np.concatenate([c for _, c, _ in out])), pa.array(np.concatenate([s for _, _, s in out]))], schema=types)

    return run


def search(spark: SparkSession, index: str | versions.Snapshot, questions: DataFrame, k: int = CANDIDATES, *, beam: int = BEAM, projects: Sequence[int] | None = None, exact: bool = False, model: str | None = None) -> DataFrame:
    """(question, chunk, score, rank): each question's (question, counts) k nearest rows of these projects (None: of all).

    Questions of ``MATRIX_BYTES`` go along with the tasks; more are taken in blocks. Questions without a length find nothing.
    """
    snapshot = versions.latest(spark, index) if isinstance(index, str) else index
    schema = f"question {questions.schema['question'].dataType.simpleString()}, chunk long, score double"
    graph = rows(spark, snapshot, model)
    size = questions.agg(F.sum(F.size("counts")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size * 8 // MATRIX_BYTES))
    every = spark.createDataFrame([], schema)
    for part in range(parts):
        mine = questions if parts == 1 else questions.where(F.pmod(F.xxhash64("question"), F.lit(parts)) == part)
        held = mine.select("question", "counts").where("counts IS NOT NULL").toArrow()
        every = every.unionByName(graph.groupBy("bucket").applyInArrow(_search(held, k, beam, projects, exact), schema))
    return ranked(every, k, F.col("score").desc_nulls_last())
