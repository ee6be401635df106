"""Exact top-k inner products by dual-tree search over cover trees.

Rows are dealt into blocks: every row goes to the nearest of ``PIVOTS`` sampled rows, and what meets at one is divided by
a hash into blocks of ``ROWS_A_BLOCK``. A task indexes one block of candidates as a cover tree and, as they stream in, groups
of queries as cover trees of their own. For centres p, q and covering radii r, s no pair of points below two nodes scores
more than <p, q> + s |p| + r |q| + r s. A pair of nodes is pruned, at inner query nodes as at leaves, once that is below the
worst k-th score of the queries below the query node.

Two rounds. First every query is answered from the block that it lies in itself; its k-th score there is a lower bound of its
k-th score overall and is handed on with it. In the second round a query goes to those blocks only that may hold a score of
that size by their pivot and radius, and comes back with scores of that size only. The work is the product of both counts
less what is pruned; no exact method is better in the worst case (near-random vectors of many dimensions prune little).

Gathered on the driver and broadcast are the pivots (``PIVOTS`` at most, and ``PIVOT_NUMBERS`` numbers), with a radius and a
number of rows each. Beyond ``QUERIES_A_TASK`` queries a block is searched by several tasks.

Components become floor(scale * x). Scores are exact: where sums of products may leave the integers that doubles hold
(vectors with components of 2 ** 23 or more, which have blocks of their own), candidates near the k-th score are compared by
unbounded integers. Defined results: vectors that are null, or hold null or non-finite components (after scaling), take no
part; vectors are compared with those of equal length, empty ones included (score 0); a score out of a long's range is
reported as the nearest long, and ranked as it is; ties go to the smaller id, null ids last; a null id is no query. Every
row is a query of its own: rows equal in id and vector have equal answers, in which the others of them are candidates; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import cut_lineage

SCALE = 64
#: Vectors below this are in ordinary blocks; products of sums below EXACT are exact in doubles.
LARGEST, EXACT = float(1 << 23), float(1 << 53)
ROWS_A_BLOCK, LEAST_BLOCKS = 8_192, 8
PIVOTS, PIVOT_NUMBERS = 1_024, 1 << 20
QUERIES_AT_ONCE, QUERIES_A_TASK = 2_048, 65_536
LEAF, FAN = 256, 16
NO_ID = 2**63 - 1
LONGS = -(2**63), 2**63 - 1
#: Pivot numbers of vectors without a pivot: of a length that no pivot has, and with large components.
NO_PIVOT, WIDE = -1, -2


@dataclass
class Tree:
    """Nodes of a cover tree: centre, covering radius, the centre's norm, children, and a leaf's points."""

    centre: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    children: list[np.ndarray | None]
    points: list[np.ndarray | None]


def cover_tree(x: np.ndarray) -> Tree:
    """Children of a node are picked farthest first until they cover its points at half its radius (or FAN are picked)."""
    centre, radius, children, points = [], [], [], []

    def node(at: np.ndarray, c: np.ndarray, r: float) -> int:
        centre.append(c)
        radius.append(r)
        children.append(None)
        points.append(at)
        return len(centre) - 1

    middle = x.mean(axis=0)
    everything = np.arange(len(x))
    todo = [node(everything, middle, float(np.sqrt(((x - middle) ** 2).sum(axis=1).max())))]
    while todo:
        n = todo.pop()
        at, r = points[n], radius[n]
        if len(at) <= LEAF or r == 0:
            continue
        own = x[at]
        nearest = ((own - centre[n]) ** 2).sum(axis=1)
        pick = int(nearest.argmax())
        owner = np.zeros(len(at), dtype=np.int64)
        nearest = ((own - own[pick]) ** 2).sum(axis=1)
        picks = [pick]
        while len(picks) < FAN and nearest.max() > (r / 2) ** 2:
            picks.append(int(nearest.argmax()))
            d = ((own - own[picks[-1]]) ** 2).sum(axis=1)
            closer = d < nearest
            owner[closer] = len(picks) - 1
            nearest = np.where(closer, d, nearest)
        if len(picks) == 1:  # the node is no wider than its first child: halve it instead
            far = int(nearest.argmax())
            d = ((own - own[far]) ** 2).sum(axis=1)
            owner = (d < nearest).astype(np.int64)
            nearest = np.minimum(nearest, d)
            picks.append(far)
        kids = []
        for k, p in enumerate(picks):
            mine = owner == k
            kids.append(node(at[mine], own[p], float(np.sqrt(nearest[mine].max()))))
        children[n], points[n] = np.array(kids), None
        todo += kids
    c = np.array(centre)
    return Tree(c, np.array(radius), np.sqrt((c**2).sum(axis=1)), children, points)


@dataclass
class Candidates:
    """Points by id; ``near`` are the same as numbers that can be squared, ``shrink`` times as large, and indexed."""

    ids: np.ndarray
    copy: np.ndarray
    x: np.ndarray
    near: np.ndarray
    shrink: float
    tree: Tree


def shrink_of(x: np.ndarray) -> float:
    """A power of two that brings large numbers down to 1; 1 for all others."""
    top = np.abs(x).max(initial=0.0)
    return 1.0 if top < 2.0**200 else 2.0 ** -int(np.frexp(top)[1])


def longest(x: np.ndarray) -> float:
    return float(np.sqrt((x**2).sum(axis=1).max(initial=0.0)))


def make_candidates(ids: np.ndarray, copies: np.ndarray, x: np.ndarray, k: int) -> Candidates:
    """Points by id. Of equal vectors only the k + 1 with the least ids can be among k best: the rest is not indexed."""
    order = np.lexsort((ids, *x.T[::-1])) if x.shape[1] else np.argsort(ids, kind="stable")
    ids, copies, x = ids[order], np.minimum(copies[order], k + 1), x[order]
    row = np.repeat(np.arange(len(ids)), copies)
    copy = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
    new = np.r_[True, (x[row[1:]] != x[row[:-1]]).any(axis=1)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    keep = np.arange(len(row)) - first <= k
    row, copy = row[keep], copy[keep]
    by_id = np.lexsort((copy, ids[row]))
    row, copy = row[by_id], copy[by_id]
    x, shrink = x[row], shrink_of(x)
    return Candidates(ids[row], copy, x, x * shrink, shrink, cover_tree(x * shrink))


def own_rows(candidates: Candidates, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each query the number of its own row among the candidates, -1 if it is elsewhere."""
    known: dict[tuple[int, bytes], int] = {}
    for j in np.flatnonzero((candidates.copy == 0) & np.isin(candidates.ids, ids)):
        known[int(candidates.ids[j]), candidates.x[j].tobytes()] = int(j)
    return np.array([known.get((int(i), v.tobytes()), -1) for i, v in zip(ids, q, strict=True)], dtype=np.int64)


@dataclass
class Found:
    """For each query its k best, first by score: scores (as doubles; exact ones in ``exact``) and candidate numbers, or -inf and -1."""

    score: np.ndarray
    which: np.ndarray
    exact: list[list[tuple[int, int]]] | None


def search(candidates: Candidates, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None) -> Found:
    """Each query's k best of the candidates, of which those below the query's ``floor`` may be missing."""
    data = candidates.tree
    shrink = shrink_of(q)
    near = q * shrink
    tree = cover_tree(near)
    wide = longest(near) * longest(candidates.near) >= EXACT * shrink * candidates.shrink
    slack = (q.shape[1] + 2) * 2.0**-52
    lengths, data_lengths = np.sqrt((near**2).sum(axis=1)), np.sqrt((candidates.near**2).sum(axis=1))
    best = np.full((len(q), k), -np.inf)
    which = np.full((len(q), k), -1, dtype=np.int64)
    exact: list[list[tuple[int, int]]] = [[] for _ in range(len(q))]
    #: the score, as a double, below which nothing matters to a query; and the least of these below each query node
    limit = np.full(len(q), -np.inf) if floor is None else floor * (shrink * candidates.shrink)
    least_limit = np.full(len(tree.radius), -np.inf)
    above = np.full(len(tree.radius), -1)
    for n, kids in enumerate(tree.children):
        if kids is not None:
            above[kids] = n

    def settle(n: int) -> None:
        """Bring a leaf's limits up to its node and to those above."""
        least_limit[n] = limit[tree.points[n]].min()
        while (n := above[n]) >= 0:
            least_limit[n] = least_limit[tree.children[n]].min()

    for n, at in enumerate(tree.points):
        if at is not None:
            settle(n)

    def bounds(n: int, nodes: np.ndarray) -> np.ndarray:
        r, norm = tree.radius[n], tree.norm[n]
        top = data.centre[nodes] @ tree.centre[n] + data.radius[nodes] * norm + data.norm[nodes] * r + data.radius[nodes] * r
        return top + 1e-9 * (np.abs(top) + (data.norm[nodes] + data.radius[nodes]) * (norm + r)) + 1e-6 * min(1.0, shrink * candidates.shrink)

    own = own_rows(candidates, ids, q)
    leaf, place = np.full(len(candidates.ids), -1), np.zeros(len(candidates.ids), dtype=np.int64)
    for n, at in enumerate(data.points):
        if at is not None:
            leaf[at], place[at] = n, np.arange(len(at))

    def scores(group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = data.points[n]
        score = near[group] @ candidates.near[at].T
        mine = np.flatnonzero((own[group] >= 0) & (leaf[own[group]] == n))
        score[mine, place[own[group[mine]]]] = -np.inf
        return at, score

    def compare(group: np.ndarray, n: int) -> None:
        at, score = scores(group, n)
        least = limit[group][:, None]
        if len(at) > k:  # what is below a row's k-th of this leaf cannot be among its k best; equals may
            least = np.maximum(least, np.partition(score, len(at) - k, axis=1)[:, len(at) - k][:, None])
        matters = score >= least
        better, which_columns = np.flatnonzero(matters.any(axis=1)), np.flatnonzero(matters.any(axis=0))
        if not len(better):
            return
        mine = group[better]
        both = np.concatenate([best[mine], score[np.ix_(better, which_columns)]], axis=1)
        numbers = np.concatenate([which[mine], np.broadcast_to(at[which_columns], (len(mine), len(which_columns)))], axis=1)
        numbers = np.where(np.isneginf(both), -1, numbers)
        order = np.lexsort((numbers, -both), axis=-1)[:, :k]  # numbers follow ids, so ties go to the smaller id
        best[mine] = np.take_along_axis(both, order, axis=1)
        which[mine] = np.take_along_axis(numbers, order, axis=1)
        limit[mine] = np.maximum(limit[mine], best[mine, -1])

    def compare_exactly(group: np.ndarray, n: int) -> None:
        """The same where doubles only say which candidates are near: those are scored in integers."""
        at, score = scores(group, n)
        away = slack * lengths[group][:, None] * data_lengths[at][None, :] + 2.0**-1_000
        low, high = score - away, score + away
        least = limit[group]
        if len(at) > k:
            least = np.maximum(least, np.partition(low, len(at) - k, axis=1)[:, len(at) - k])
        for i, row in enumerate(group.tolist()):
            hits = np.flatnonzero((high[i] >= least[i]) & ~np.isneginf(score[i]))
            if not len(hits):
                continue
            asked = list(map(int, q[row]))
            held = exact[row] + [(-sum(map(mul, asked, map(int, candidates.x[j]))), j) for j in at[hits].tolist()]
            exact[row] = sorted(held)[:k]
            if len(exact[row]) == k:
                last = exact[row][-1][1]
                limit[row] = max(limit[row], near[row] @ candidates.near[last] - slack * lengths[row] * data_lengths[last] - 2.0**-1_000)

    with np.errstate(invalid="ignore", over="ignore"):
        todo = [(0, np.array([0]))]
        while todo:
            n, frontier = todo.pop()  # candidate nodes that cover all that may still matter to the queries below n
            reach = bounds(n, frontier)
            frontier, reach = (x[~(reach < least_limit[n])] for x in (frontier, reach))
            if not len(frontier):
                continue
            group = tree.points[n]
            if group is None:
                wider = [data.children[f] if data.children[f] is not None and data.radius[f] >= tree.radius[n] else np.array([f]) for f in frontier]
                todo += [(int(child), np.concatenate(wider)) for child in tree.children[n]]
                continue
            heap = [(-b, int(f)) for b, f in zip(reach, frontier, strict=True)]
            heapq.heapify(heap)
            while heap:
                bound, f = heapq.heappop(heap)
                if -bound < limit[group].min():
                    break
                if data.children[f] is None:
                    (compare_exactly if wide else compare)(group, f)
                else:
                    for b, child in zip(bounds(n, data.children[f]), data.children[f], strict=True):
                        heapq.heappush(heap, (-b, int(child)))
            settle(n)
    return Found(best / (shrink * candidates.shrink), which, exact if wide else None)


def found_rows(found: Found) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """(query, candidate, score as a long, key): the key orders scores out of the longs' range, and is None within it."""
    if found.exact is None:
        i, j = np.nonzero(found.which >= 0)
        return i, found.which[i, j], found.score[i, j].astype(np.int64), [None] * len(i)
    rows = [(i, j, -s) for i, best in enumerate(found.exact) for s, j in best]
    keys = [None if LONGS[0] < s < LONGS[1] else sort_key(s) for _, _, s in rows]
    columns = [np.array([r[c] for r in rows], dtype=np.int64) for c in (0, 1)]
    return *columns, np.array([max(LONGS[0], min(LONGS[1], s)) for _, _, s in rows], dtype=np.int64), keys


def sort_key(score: int) -> bytes:
    """Bytes in the order of the integers."""
    size = (score.bit_length() + 7) // 8
    if score >= 0:
        return b"\1" + size.to_bytes(4, "big") + score.to_bytes(size, "big")
    return b"\0" + bytes(255 - x for x in size.to_bytes(4, "big") + (-score).to_bytes(size, "big"))


def _matrix(table, dim: int, name: str = "v") -> np.ndarray:
    column = table[name].combine_chunks() if isinstance(table, pa.Table) else table.column(table.schema.get_field_index(name))
    return column.flatten().to_numpy().reshape(len(column), dim)


_FOUND = "query long, query_id long, copies long, vec_id long, score long, key binary"


def _search_blocks(k: int):
    """Rows sorted by (block, part, dim, is_query): each block's candidates, then its queries."""

    def answer(held: Candidates | None, rows: list[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
        if held is None or not rows:
            return
        table = pa.Table.from_batches(rows)
        ids, query, copies, floor, q = (*(table[c].to_numpy() for c in ("vec_id", "row", "n", "floor")), _matrix(table, dim))
        large = np.abs(q).max(axis=1, initial=0.0) >= LARGEST  # one of these would make all its group's comparisons slow
        for mine in (np.flatnonzero(~large), np.flatnonzero(large)):
            if len(mine):
                i, j, score, key = found_rows(search(held, ids[mine], q[mine], k, floor[mine]))
                i = mine[i]
                yield pa.RecordBatch.from_arrays([pa.array(query[i]), pa.array(ids[i]), pa.array(copies[i]), pa.array(held.ids[j]), pa.array(score), pa.array(key, pa.binary())], names=["query", "query_id", "copies", "vec_id", "score", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, rows, queries = None, None, [], []

        def index() -> Candidates:
            table = pa.Table.from_batches(rows)
            return make_candidates(table["vec_id"].to_numpy(), table["n"].to_numpy(), _matrix(table, now[2]), k)

        for batch in batches:
            keys = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("block", "part", "dim", "is_query")]
            cuts = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in keys], axis=0)]) if batch.num_rows else []
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                key, is_query = tuple(int(x[a]) for x in keys[:3]), bool(keys[3][a])
                if key != now:
                    if now is not None:
                        yield from answer(held, queries, now[2])
                    now, held, rows, queries = key, None, [], []
                if not is_query:
                    rows.append(batch.slice(a, b - a))
                    continue
                if rows:
                    held, rows = index(), []
                for c in range(a, b, QUERIES_AT_ONCE):
                    queries.append(batch.slice(c, min(b, c + QUERIES_AT_ONCE) - c))
                    if sum(x.num_rows for x in queries) >= QUERIES_AT_ONCE:
                        yield from answer(held, queries, now[2])
                        queries = []
        if now is not None:
            yield from answer(held, queries, now[2])

    return run


@dataclass
class Pivots:
    """The sampled rows by their length, numbered through; and once they are known, each one's radius, first block and blocks."""

    of: dict[int, tuple[np.ndarray, np.ndarray]]
    radius: dict[int, float]
    first: dict[int, int]
    blocks: dict[int, int]


def _assign(pivots):
    """Adds to every row its pivot and how far away it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            pivot, away = np.full(batch.num_rows, NO_PIVOT, dtype=np.int32), np.full(batch.num_rows, np.inf)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = _matrix(batch.take(pa.array(at)), dim)
                large = np.abs(x).max(axis=1, initial=0.0) >= LARGEST
                pivot[at[large]] = WIDE
                if dim in pivots.value.of and not large.all():
                    at, x = at[~large], x[~large]
                    numbers, centres = pivots.value.of[dim]
                    d = np.maximum((x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T), 0)
                    nearest = d.argmin(axis=1)
                    pivot[at], away[at] = numbers[nearest], np.sqrt(d[np.arange(len(at)), nearest])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(away)], names=[*batch.schema.names, "pivot", "away"])

    return run


def _route(pivots):
    """Queries with their lower bound -> with the other blocks that may hold as much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        ranges = {n: np.arange(p.first[n], p.first[n] + p.blocks[n], dtype=np.int32) for n in p.first}
        for batch in batches:
            dims, own, floor = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("dim", "block", "floor"))
            out: list[np.ndarray] = [np.empty(0, np.int32)] * batch.num_rows
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                numbers, centres = p.of.get(dim, (np.empty(0, np.int64), np.empty((0, dim))))
                known = np.flatnonzero([n in p.first for n in numbers.tolist()])
                numbers, centres = numbers[known], centres[known]
                q, radius = _matrix(batch.take(pa.array(at)), dim), np.array([p.radius[n] for n in numbers.tolist()])
                length = np.sqrt((q**2).sum(axis=1))[:, None]
                with np.errstate(invalid="ignore", over="ignore"):
                    reach = q @ centres.T + length * radius[None, :]
                    reach += 1e-6 + 1e-6 * length * (np.sqrt((centres**2).sum(axis=1)) + radius)[None, :]
                    open_to = ~(reach < floor[at][:, None])
                always = [ranges[n] for n in (NO_PIVOT, WIDE) if n in ranges]
                for i, row in zip(at.tolist(), open_to, strict=True):
                    blocks = np.concatenate([*(ranges[n] for n in numbers[row].tolist()), *always, np.empty(0, np.int32)])
                    out[i] = blocks[blocks != own[i]]
            names = [n for n in batch.schema.names if n != "block"]
            ends = np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*out, np.empty(0, np.int32)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), lists], names=[*names, "blocks"])

    return run


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, or null for a vector that takes no part."""
    wide = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    finite = F.forall(wide, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    whole = F.transform(wide, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    return F.when(vector.isNotNull() & finite, whole)


def pick_pivots(rows: DataFrame, blocks: int, dim: int) -> Pivots:
    """Distinct ordinary vectors by the order of a hash."""
    most = max(1, min(PIVOTS, blocks, PIVOT_NUMBERS // max(1, dim)))
    ordinary = rows.filter(F.forall("v", lambda x: F.abs(x) < LARGEST) & (F.col("dim") > 0))
    seen = {tuple(r["v"]) for r in ordinary.select("v").orderBy(F.xxhash64("row"), "row").limit(2 * most).collect()}
    by_dim: dict[int, list[tuple]] = {}
    for v in sorted(seen)[:: max(1, -(-len(seen) // most))]:
        by_dim.setdefault(len(v), []).append(v)
    of, n = {}, 0
    for size, vectors in sorted(by_dim.items()):
        of[size] = (np.arange(n, n + len(vectors)), np.array(vectors))
        n += len(vectors)
    return Pivots(of, {}, {}, {})


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row where ``is_query`` holds."""
    context = vectors.sparkSession.sparkContext
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col), scale).alias("v"), (F.coalesce(is_query, F.lit(False)) & F.col(id_col).isNotNull()).alias("asks")).filter("v IS NOT NULL")
    rows = rows.groupBy("vec_id", "v").agg(F.count("*").alias("n"), F.count_if("asks").alias("copies"))
    rows = cut_lineage(rows.select(F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "v", "n", "copies", F.size("v").alias("dim"), F.xxhash64("vec_id", "v").alias("row")))
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("copies") > 0).alias("q"), F.max("dim").alias("dim")).first()
    a_block = max(1, min(ROWS_A_BLOCK, -(-counts["n"] // LEAST_BLOCKS)))
    parts = max(1, -(-counts["q"] // QUERIES_A_TASK))

    pivots = pick_pivots(rows, -(-counts["n"] // a_block), counts["dim"] or 0)
    columns = "vec_id long, v array<double>, n long, copies long, dim int, row long"
    assigned = cut_lineage(rows.mapInArrow(_assign(context.broadcast(pivots)), f"{columns}, pivot int, away double"))
    blocks = 0
    for r in sorted(assigned.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()):
        pivots.first[r["pivot"]], pivots.blocks[r["pivot"]], pivots.radius[r["pivot"]] = blocks, -(-r["n"] // a_block), r["radius"]
        blocks += pivots.blocks[r["pivot"]]
    held = context.broadcast(pivots)
    numbers = lambda of: F.create_map(*[F.lit(x) for item in (of or {NO_PIVOT: 0}).items() for x in item])[F.col("pivot")]
    block = (numbers(pivots.first) + F.pmod("row", numbers(pivots.blocks))).cast("int")
    dealt = assigned.withColumn("block", block)
    data = dealt.select("block", "dim", F.lit(0).alias("is_query"), "row", "vec_id", "n", "v", F.lit(0.0).alias("floor"))
    asked = dealt.filter("copies > 0").select("block", "dim", F.lit(1).alias("is_query"), "row", "vec_id", F.col("copies").alias("n"), "v", F.lit(float("-inf")).alias("floor"))

    def searched(candidates: DataFrame, queries: DataFrame) -> DataFrame:
        both = candidates.unionByName(queries).repartition(max(1, blocks) * parts, "block", "part").sortWithinPartitions("block", "part", "dim", "is_query")
        return both.mapInArrow(_search_blocks(k), _FOUND)

    near = cut_lineage(searched(data.withColumn("part", F.lit(0)), asked.withColumn("part", F.lit(0))))
    last = F.when(F.count("*") == k, F.min("score").cast("double"))
    floors = near.groupBy(F.col("query").alias("of"), F.col("query_id").alias("of_id")).agg(F.when(last > float(LONGS[0]), last - F.abs(last) * 1e-15).alias("k_th"))
    bounded = asked.join(floors, (F.col("row") == F.col("of")) & (F.col("vec_id") == F.col("of_id")), "left").withColumn("floor", F.coalesce("k_th", "floor"))
    routed = bounded.select(*asked.columns).mapInArrow(_route(held), "dim int, is_query int, row long, vec_id long, n long, v array<double>, floor double, blocks array<int>")
    routed = routed.withColumn("block", F.explode("blocks")).drop("blocks").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    copied = data.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = near.unionByName(searched(copied, routed))
    order = Window.partitionBy("query", "query_id").orderBy(F.col("score").desc(), F.col("key").desc_nulls_last(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    ranked = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") < NO_ID, F.col("vec_id")).alias("vec_id"), "score")
