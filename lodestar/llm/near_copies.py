"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash finds candidates, the sets themselves decide. Texts with equal sets are folded first. Each distinct set votes
once a shingle on ``BITS`` bits; at a similarity of 0.8 about 0.15 of the bits differ, of unrelated texts half of them.

Candidates: anchor-point covering, as in ``simhash``, on the long fingerprint. A table takes 23 of its bits; the anchors are the words
of the binary Golay code on these, a perfect code with covering radius 3. A set is replicated to every anchor within covering radius plus
the table's threshold, 3 + 1 = 4: its own anchor, and five others if that one is 3 away. Two sets of which at most one of the 23 bits
differs therefore always meet, and two of which each bit differs with ``SHARE_APART`` meet with ``MEETS``. In a large corpus an anchor holds
only sets that agree in some further bits, so that about ``AT_ANCHOR`` of them are at each; tables are made until a pair of that share fails
to meet in all of them with a probability of ``MISSED``. Sets that meet are linked if ``NEAR`` of the first 192 bits or fewer differ. Crowded
anchors are dealt into pairs of slices.

Decision: exact similarity along the candidates' links first, each linked text against the one it is linked to, which goes through
a large group once. Where that leaves a connected component of candidates in more than one piece, all pairs of it are compared, met
or not, but for those within its largest piece: slices of that one meet slices of the rest. So a group of copies costs what it has
rows, and texts are sent more than twice only where a component holds many that are unlike its largest piece. The connected components of
all links found are the groups.

Defined results: texts without words are copies of each other; texts of fewer than five words have one shingle; null ids
come after all others; repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.components import label_components
from lodestar.llm.shared import cut_lineage, text_column
from lodestar.llm.simhash import _LOWER, SEED, _slices

SHINGLE = 5
#: Least similarity, as a fraction.
SIMILAR = (4, 5)
BITS = 512
WORDS = BITS // 64
NEAR_WORDS = 3
NEAR = 54
#: The Golay code's length, its check bits and its generator; distance within which a set goes to an anchor.
CODE, CHECKS, GENERATOR = 23, 11, 0b101011100011
COVERING_RADIUS, APART_AT_ANCHOR = 3, 1
AT_ANCHOR = 64
SHARE_APART = 0.17
#: Probability that two sets share an anchor if each bit differs with SHARE_APART (by all 2**23 differences); anchors of a set on average.
MEETS, ANCHORS = 0.530, 5.32
MISSED = 0.001
#: Rows and shingles in one slice of a component of candidates, and ids that are broadcast rather than shuffled.
LEAST_ROWS, MOST_ROWS, MOST_SHINGLES = 128, 2_048, 1_000_000
MOST_BROADCAST = 500_000
#: Bits of the map of rows that go; when it fills up, more rows are joined and the result is the same.
MARKS = 1 << 25
NO_ID = 2**63 - 1
#: Groups up to this size are compared as one matrix.
_MATRIX = 512
_STEPS = (np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes (XXH64) of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(n)), dtype=np.uint64, count=n))


def long_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of a set, ``WORDS`` words; each word's bits come from one more mixing of the shingle's hash."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(shingles), 255):
        x = shingles[at : at + 255, None] + _STEPS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, size, words = [], [], []
        for text in batch.column(2):
            s = shingle_set(text.as_py())
            node.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
            size.append(len(s))
            words.append(long_fingerprint(s).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(words, pa.binary())], names=["rid", "th", "node", "size", "words"])


def _syndromes() -> np.ndarray:
    """What each bit of a word contributes to its checks: the remainder of its power by the generator."""
    out = []
    for i in range(CODE):
        v = 1 << i
        for b in range(CODE - 1, CHECKS - 1, -1):
            if v >> b & 1:
                v ^= GENERATOR << (b - CHECKS)
        out.append(v)
    return np.array(out, dtype=np.int64)


def _flips() -> np.ndarray:
    """By checks: which bits to flip to reach the anchors within covering radius and threshold, the own one first; -1 for none."""
    of, found = _syndromes().tolist(), [[] for _ in range(1 << CHECKS)]
    for weight in range(COVERING_RADIUS + APART_AT_ANCHOR + 1):
        for places in combinations(range(CODE), weight):
            s = v = 0
            for i in places:
                s, v = s ^ of[i], v | 1 << i
            found[s].append(v)
    most = max(map(len, found))
    return np.array([x + [-1] * (most - len(x)) for x in found], dtype=np.int64)


def anchors(words: np.ndarray) -> np.ndarray:
    """Words of ``CODE`` bits -> a row of anchors for each, -1 where there are fewer."""
    if not _FLIPS:
        _FLIPS.append(_flips())
    checks = np.zeros(len(words), dtype=np.int64)
    for i, s in enumerate(_syndromes().tolist()):
        checks ^= (words >> i & 1) * s
    flips = _FLIPS[0][checks]
    return np.where(flips < 0, -1, words[:, None] ^ flips)


_FLIPS: list[np.ndarray] = []


def tables_for(n: int) -> list[np.ndarray]:
    """The bits of every table for ``n`` distinct sets: ``CODE`` of the code, then those in which sets at an anchor agree."""
    crowd = max(n, 1) * ANCHORS / (1 << (CODE - CHECKS)) / AT_ANCHOR
    agree = min(24, max(0, round(math.log2(crowd))))
    tables = math.ceil(math.log(MISSED) / math.log1p(-MEETS * (1 - SHARE_APART) ** agree))
    rng = np.random.default_rng(SEED)
    return [rng.permutation(BITS)[: CODE + agree] for _ in range(tables)]


def _place(tables: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                node = batch.column(0).to_numpy()
                words = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u8").reshape(-1, WORDS)
                bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
                keys, rows = [], []
                for j, t in enumerate(tables):
                    word = bits[:, t].astype(np.int64) @ (1 << np.arange(len(t), dtype=np.int64))
                    at_anchor = anchors(word & (1 << CODE) - 1)
                    row, k = np.nonzero(at_anchor >= 0)
                    keys.append(at_anchor[row, k] | word[row] >> CODE << CODE | j << 48)
                    rows.append(row)
                row = np.concatenate(rows)
                near = [pa.array(np.ascontiguousarray(words[:, k]).view(np.int64)[row]) for k in range(NEAR_WORDS)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(node[row]), *near], names=["key", "node", "w0", "w1", "w2"])

    return run


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits that differ, of each row of x to each of y."""
    return sum(np.bitwise_count(x[:, None, k] ^ y[None, :, k]).astype(np.int16) for k in range(NEAR_WORDS))


def _candidates(node: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what chains of near pairs connect: all pairs if they are few, else a forest."""
    n = len(node)
    if n <= _MATRIX:
        a, b = np.nonzero(np.triu(_apart(words, words) <= NEAR, 1))
        if len(a) <= n:
            return node[a], node[b]
    label = np.full(n, -1, dtype=np.int64)
    for root in range(n):
        if label[root] >= 0:
            continue
        label[root] = root
        front = np.array([root])
        while len(front) and len(free := np.flatnonzero(label < 0)):
            found = np.zeros(len(free), dtype=bool)
            step = max(1, 2_000_000 // len(free))
            for at in range(0, len(front), step):
                found |= (_apart(words[front[at : at + step]], words[free]) <= NEAR).any(axis=0)
            front = free[found]
            label[front] = root
    members = np.flatnonzero(label != np.arange(n))
    return node[members], node[label[members]]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, node, words), sorted by key, part and node -> links (a, b), to the same least nodes from every table."""
    def emit(rows: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        found = [_candidates(rows[at:to, 2], np.ascontiguousarray(rows[at:to, 3:]).view(np.uint64)) for at, to in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True) if to - at > 1]
        if not found or not sum(len(a) for a, _ in found):
            return None
        pairs = np.stack([np.concatenate([x[k] for x in found]) for k in (0, 1)], axis=1)
        pairs = np.unique(np.stack([pairs.max(axis=1), pairs.min(axis=1)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
        differs = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
        cut = differs[-1] + 1 if len(differs) else 0
        if not cut and held and (held[-1][-1, :2] != rows[-1, :2]).any():
            done, held = np.concatenate(held), []
        elif cut:
            done, held = np.concatenate([*held, rows[:cut]]), []
        else:
            done = None
        held.append(rows[cut:])
        if done is not None and (out := emit(done)) is not None:
            yield out
    if held and (out := emit(np.concatenate(held))) is not None:
        yield out


def candidate_links(distinct: DataFrame) -> DataFrame:
    """(node, words) of distinct sets -> links (a, b) whose chains join nearly all similar ones, and others."""
    n = distinct.count()
    tables = tables_for(n)
    rows = distinct.select("node", "words").mapInArrow(_place(tables), "key long, node long, w0 long, w1 long, w2 long")
    dealt = _slices(rows.select("key", F.struct("node", "w0", "w1", "w2").alias("fp")), math.ceil(n * len(tables) * ANCHORS)).select("key", "part", "fp.node", "fp.w0", "fp.w1", "fp.w2")
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(_meet, "a long, b long")


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b), b the smaller -> fewer that connect the same: what a node links to is linked to the least of these.

    A large group meets at several anchors in every table, and a node has a link for each of them: their number is bounded
    by that of tables and slices. Nearly all nodes of the group have its least node among these, or one in common; what is
    left beside one link a node are links between the nodes that others were linked to, which a second time thins out.
    """
    near = links.groupBy("a").agg(F.collect_set("b").alias("all")).withColumn("least", F.array_min("all"))
    return near.select(F.explode(F.array_union(F.array("a"), "all")).alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()


def similar_links(sets: Sequence[np.ndarray]) -> list[tuple[int, int]]:
    """A forest that connects what chains of similar sets connect; every pair counts, by exact similarity."""
    n, size = len(sets), np.array([len(s) for s in sets])
    inverse = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner, ends = np.repeat(np.arange(n), size), np.r_[0, np.cumsum(size)]
    seen = np.zeros(inverse.max(initial=-1) + 1, dtype=bool)
    label = np.full(n, -1, dtype=np.int64)
    links = []
    for root in range(n):
        if label[root] >= 0:
            continue
        label[root] = root
        front = [root]
        while front:
            x = front.pop()
            if not ((label < 0) & (SIMILAR[1] * np.minimum(size, size[x]) >= SIMILAR[0] * np.maximum(size, size[x]))).any():
                continue
            own = inverse[ends[x] : ends[x + 1]]
            seen[own] = True
            common = np.bincount(owner[seen[inverse]], minlength=n)
            seen[own] = False
            near = np.flatnonzero((label < 0) & (SIMILAR[1] * common >= SIMILAR[0] * (size + size[x] - common)))
            label[near] = root
            front += near.tolist()
            links += [(int(y), x) for y in near]
    return links


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, part, node, text), sorted by component and part -> links (a, b) of similar texts."""
    def emit(nodes: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(nodes) > 1 and (links := similar_links(sets)):
            yield pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    at, nodes, sets = None, [], []
    for batch in batches:
        for component, part, node, text in zip(*batch.columns, strict=True):
            key = component.as_py(), part.as_py()
            if key != at:
                yield from emit(nodes, sets)
                at, nodes, sets = key, [], []
            nodes.append(node.as_py())
            sets.append(shingle_set(text.as_py()))
    yield from emit(nodes, sets)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, salt, node, text), a hub's own first in each salt -> links (a, b) of texts that are similar to their hub."""
    at, own = None, np.empty(0, dtype=np.uint64)
    for batch in batches:
        found: list[tuple[int, int]] = []
        for hub, salt, node, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (hub, salt) != at:
                at, own = (hub, salt), shingle_set(text)
            elif node != hub:
                other = shingle_set(text)
                if SIMILAR[1] * min(len(own), len(other)) >= SIMILAR[0] * max(len(own), len(other)):
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    if SIMILAR[1] * common >= SIMILAR[0] * (len(own) + len(other) - common):
                        found.append((node, hub))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _met(docs: DataFrame, wanted: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """The rows of ``wanted`` (of_rid, of_th and others, all of a fixed size), each with its text."""
    rows = docs.select(*_keyed(docs, text_col, id_col), text_column(docs, text_col).alias("text"))
    few = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    return rows.join(few, (F.col("rid") == F.col("of_rid")) & (F.col("th") == F.col("of_th"))).drop("rid", "th", "of_rid", "of_th")


def verified_links(docs: DataFrame, links: DataFrame, sizes: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Those of the links (a, b) whose texts are similar; a hub's text is sent once for so many rows linked to it."""
    salts = links.groupBy(F.col("b").alias("hub")).agg(F.ceil(F.count("*") / MOST_ROWS).cast("int").alias("salts"))
    linked = links.select(F.col("a").alias("node"), F.col("b").alias("hub")).join(salts, "hub").select("hub", F.pmod(F.xxhash64("node", F.lit(7)), F.col("salts")).cast("int").alias("salt"), "node")
    hubs = salts.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("node"))
    wanted = cut_lineage(linked.unionByName(hubs).join(sizes.select("node", F.col("rid").alias("of_rid"), F.col("th").alias("of_th")), "node"))
    met = _met(docs, wanted, text_col, id_col).select("hub", "salt", "node", "text", (F.col("node") != F.col("hub")).alias("other"))
    dealt = met.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "other").select("hub", "salt", "node", "text")
    return dealt.mapInArrow(_along, "a long, b long")


def remaining_links(docs: DataFrame, sizes: DataFrame, text_col: str, id_col: str) -> DataFrame | None:
    """Links between the pieces of components that are in several: nodes (component, node, piece, size, rid, th) -> (a, b)."""
    pieces = sizes.groupBy("component", "piece").agg(F.count("*").alias("rows"))
    split = pieces.groupBy("component").agg(F.count("*").alias("pieces"), F.max_by("piece", F.struct("rows", "piece")).alias("main")).filter("pieces > 1")
    rows = cut_lineage(sizes.join(split.select("component", "main"), "component").withColumn("is_main", F.col("piece") == F.col("main")).select("component", "node", "size", "rid", "th", "is_main"))
    if rows.isEmpty():
        return None
    of = lambda c, test: F.sum(F.when(test, F.col(c) if c else 1).otherwise(0))
    main = F.col("is_main")
    sums = rows.groupBy("component").agg(F.count("*").alias("rows"), of("", main).alias("n_main"), of("size", main).alias("s_main"), of("", ~main).alias("n_rest"), of("size", ~main).alias("s_rest"))
    a_slice = F.greatest(F.lit(LEAST_ROWS), F.least(F.lit(MOST_ROWS), 4 * F.sqrt("rows")))
    slices = lambda n, s: F.ceil(F.greatest(F.col(n) / a_slice, F.col(s) / MOST_SHINGLES)).cast("int")
    sums = sums.select("component", slices("n_main", "s_main").alias("k"), slices("n_rest", "s_rest").alias("m"))
    hashed = F.xxhash64("node", F.lit(7))
    own = F.when(main, F.pmod(hashed, F.col("k"))).otherwise(F.col("k") + F.pmod(hashed, F.col("m"))).cast("int")
    asked = cut_lineage(rows.join(sums, "component").select("component", "node", "is_main", "k", "m", own.alias("own"), F.col("rid").alias("of_rid"), F.col("th").alias("of_th")))
    slice_of, n = F.col("own"), F.col("k") + F.col("m")
    others = F.sequence(F.when(main, F.col("k")).otherwise(F.lit(0)), n - 1)  # the main piece's slices do not meet each other
    parts = F.transform(others, lambda t: F.least(t, slice_of) * n + F.greatest(t, slice_of))
    texts = _met(docs, asked, text_col, id_col).select("component", F.explode(parts).alias("part"), "node", "text")
    return texts.repartition("component", "part").sortWithinPartitions("component", "part").mapInArrow(_decide, "a long, b long")


def _keyed(docs: DataFrame, text_col: str, id_col: str):
    """A row's id and the hash of its text: rows that agree in both are repeated."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rid"), F.xxhash64(text_column(docs, text_col)).alias("th")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, th, component) of every row, and how often that row is there (n)."""
    text = text_column(docs, text_col)
    marked = docs.select(*_keyed(docs, text_col, id_col), text.alias("text")).mapInArrow(_mark, "rid long, th long, node long, size long, words binary")
    marked = cut_lineage(marked.groupBy("rid", "th", "node").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("words").alias("words")))
    distinct = cut_lineage(marked.groupBy("node").agg(F.min(F.struct("rid", "th")).alias("first"), F.first("size").alias("size"), F.first("words").alias("words")).filter("size > 0"))
    links = cut_lineage(contracted(contracted(candidate_links(distinct))))
    sizes = cut_lineage(distinct.join(label_components(links), "node").select("component", "node", "size", "first.rid", "first.th"))
    pieces = label_components(cut_lineage(verified_links(docs, links, sizes, text_col, id_col))).withColumnRenamed("component", "piece")
    sizes = cut_lineage(sizes.join(pieces, "node", "left").withColumn("piece", F.coalesce("piece", "node")))
    found, more = sizes.select("node", F.col("piece").alias("component")), remaining_links(docs, sizes, text_col, id_col)
    if more is not None:
        between = more.unionByName(sizes.filter("node <> piece").select(F.col("node").alias("a"), F.col("piece").alias("b")))
        found = label_components(cut_lineage(between))
    named = found.withColumnRenamed("node", "of_node")
    return marked.join(named, F.col("node") == F.col("of_node"), "left").select("rid", "th", "n", F.coalesce("component", "node").alias("component"))


def _marked(marks):
    """Whether a row's bit is set; only ids and hashes go to Python, the row's text does not."""

    @F.pandas_udf("boolean")
    def is_marked(rid: pd.Series, th: pd.Series) -> pd.Series:
        at = _mark_of(rid.to_numpy(), th.to_numpy())
        return pd.Series((marks.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return is_marked


def _mark_of(rid: np.ndarray, th: np.ndarray) -> np.ndarray:
    x = (rid.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ th.astype(np.int64).view(np.uint64)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(MARKS - 1)).astype(np.int64)


def _bit_map(keys: DataFrame):
    """A broadcast bit map of MARKS bits, set for these (rid, th): bytes are gathered, at most MARKS / 8 of them."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(MARKS // 8, dtype=np.uint8)
        for batch in batches:
            at = _mark_of(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        at = np.flatnonzero(held)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 16)]), pa.array(held[at[k : k + (1 << 16)]].astype(np.int32))], names=["at", "bits"])

    out = np.zeros(MARKS // 8, dtype=np.uint8)
    for row in keys.mapInArrow(bits, "at long, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[row["at"]] = row["bits"]
    return keys.sparkSession.sparkContext.broadcast(out)


def keep_one_each(docs: DataFrame, columns: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``columns`` of one row of each group of near copies: the one with the smallest id.

    Who goes is found on narrow rows. Rows whose bit is not set in a bit map of those that go (or are there several times)
    stay where they are; only the others, and the few that share a bit with one, meet the survivors in a join.
    """
    groups = cut_lineage(near_groups(docs, id_col, text_col))
    first = groups.groupBy("component").agg(F.min(F.struct("rid", "th", "n")).alias("first"))
    survivors = cut_lineage(first.select(F.col("first.rid").alias("of_rid"), F.col("first.th").alias("of_th"), F.col("first.n").alias("n")))
    gone = groups.join(survivors, (F.col("rid") == F.col("of_rid")) & (F.col("th") == F.col("of_th")), "left_anti").select("rid", "th")
    marks = _bit_map(gone.unionByName(survivors.filter("n > 1").select(F.col("of_rid").alias("rid"), F.col("of_th").alias("th"))))
    rows = docs.select(*columns, *_keyed(docs, text_col, id_col)).withColumn("marked", _marked(marks)("rid", "th"))
    unsure = rows.filter("marked").join(survivors, (F.col("rid") == F.col("of_rid")) & (F.col("th") == F.col("of_th")), "left_semi").dropDuplicates(["rid", "th"])
    return rows.filter("NOT marked").unionByName(unsure).select(*columns)
