"""The pipeline's near copies against the exact similarity of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lodestar.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def direct_survivors(rows):
    """The least id of each group of rows whose similarity is 0.8 or more, by chains; null ids come last."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for (i, _), g in zip(rows, label, strict=True):
        least[g] = min(least.get(g, 2**63), 2**63 if i is None else i)
    return sorted(least.values())


def survivors(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    return sorted(2**63 if r.doc_id is None else r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "unused").collect())


def edited(rng, text, edits):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def edited_rows():
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(60, 500))) for _ in range(40)]
    rows = list(enumerate(base))
    rows += [(100 + k, edited(rng, base[k % 40], max(1, len(base[k % 40].split()) * (k % 5) // 160))) for k in range(80)]
    return rows + [(None, edited(rng, base[2], 1)), (300, None), (301, ""), (302, "two words"), (303, "Two  WORDS"), (5, base[5]), (None, "no id and no copies of it here")]


def test_edited_copies_go(spark):
    """Links of 64 bits with at most 3 apart leave most of these edited copies in."""
    rows = edited_rows()
    wanted = direct_survivors(rows)
    assert survivors(spark, rows) == wanted
    assert len(wanted) < len({simhash.fingerprint(t) for _, t in rows}) - 20


def test_crowded_groups_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "LEAST_ROWS", 4)
    monkeypatch.setattr(near_copies, "MOST_ROWS", 4)
    monkeypatch.setattr(near_copies, "MOST_BROADCAST", 0)
    monkeypatch.setattr(simhash, "MOST_AT_ANCHOR", 16)
    rng = random.Random(6)
    base = " ".join(f"w{rng.randrange(900)}" for _ in range(200))
    rows = [(k, edited(rng, base, rng.randint(0, 12))) for k in range(60)]
    assert survivors(spark, rows) == direct_survivors(rows)


@pytest.mark.parametrize("rows", [None, 8])
def test_a_large_group_a_chain_and_texts_beside_them(spark, monkeypatch, rows):
    """A group around one text, a chain whose ends are unlike, and a very long text with its copy."""
    if rows:
        for name in ("LEAST_ROWS", "MOST_ROWS"):
            monkeypatch.setattr(near_copies, name, rows)
    rng = random.Random(16)
    word = lambda: f"w{rng.randrange(5_000)}"
    base = " ".join(word() for _ in range(150))
    found = [edited(rng, base, rng.randint(0, 3)) for _ in range(120)]
    link = [word() for _ in range(120)]
    for _ in range(50):
        link = link[6:] + [word() for _ in range(6)]
        found.append(" ".join(link))
    long_text = " ".join(word() for _ in range(60_000))
    found += [long_text, edited(rng, long_text, 300), " ".join(word() for _ in range(90))]
    rng.shuffle(found)
    numbered = list(enumerate(found))
    wanted = direct_survivors(numbered)
    assert 4 <= len(wanted) <= 30 and survivors(spark, numbered) == wanted


def test_unlike_candidates_stay(spark):
    """A chance meeting of fingerprints is no copy: half of the words are the same, in one order."""
    rng = random.Random(9)
    half = " ".join(f"w{rng.randrange(900)}" for _ in range(300))
    rows = [(k, half + " " + " ".join(f"w{rng.randrange(900)}" for _ in range(100))) for k in range(6)]
    assert survivors(spark, rows) == direct_survivors(rows) == list(range(6))


@pytest.mark.parametrize("n", [3, 700])
def test_candidates_of_large_and_small_groups(n):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, (3, 3), dtype=np.uint64) << np.uint64(1)
    words = centres[np.arange(n) % 3] ^ (np.uint64(1) << rng.integers(0, 64, (n, 3), dtype=np.uint64))
    a, b = near_copies._candidates(np.arange(n), words)
    assert len(a) == n - min(n, 3) and (a % 3 == b % 3).all()


@pytest.mark.parametrize("step", [1, 2, 5, 50])
def test_groups_are_carried_over_batches(step):
    key = np.repeat(np.arange(10), 5)
    columns = [key, np.zeros(50, dtype=np.int32), np.arange(50), *[np.where(key % 2, -1, 7)] * 3]
    rows = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "part", "node", "w0", "w1", "w2"])
    links = {r for b in near_copies._meet(iter([rows.slice(i, step) for i in range(0, 50, step)])) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert links == {(5 * g + k, 5 * g) for g in range(10) for k in range(1, 5)}


def test_anchors_cover():
    """Every word has its own anchor within 3; words that differ in one bit share one; shares apart meet as often as is counted on."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 23, 20_000)
    of_x = near_copies.anchors(x)
    apart = np.where(of_x < 0, 99, np.bitwise_count(of_x ^ x[:, None]))
    assert apart[:, 0].max() == 3 and (np.sort(apart, axis=1)[:, 1] >= 4).all() and apart[apart < 99].max() == 4
    assert not near_copies.anchors(of_x[:, 0])[:, 1:].max() >= 0  # an anchor is its own, with no other near it
    assert abs((of_x >= 0).sum(axis=1).mean() - near_copies.ANCHORS) < 0.1

    def meet(y):
        of_y = near_copies.anchors(y)
        return ((of_x[:, :, None] == of_y[:, None, :]) & (of_x >= 0)[:, :, None]).any(axis=(1, 2))

    assert all(meet(x ^ (1 << i)).all() for i in range(23))
    differs = (rng.random((len(x), 23)) < near_copies.SHARE_APART) @ (1 << np.arange(23))
    assert abs(meet(x ^ differs).mean() - near_copies.MEETS) < 0.02


@pytest.mark.parametrize("n", [10, 100_000, 10**9])
def test_sets_are_at_their_anchors_in_every_table(n):
    tables = near_copies.tables_for(n)
    words = np.random.default_rng(2).integers(0, 2**63, (3, near_copies.WORDS), dtype=np.uint64)
    rows = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array([w.tobytes() for w in words], pa.binary())], names=["node", "words"])
    placed = pa.Table.from_batches(near_copies._place(tables)(iter([rows]))).to_pandas()
    assert len(set(zip(placed.key, placed.node))) == len(placed)
    assert placed.groupby(placed.key // 2**48).node.agg(set).map({7, 8, 9}.__eq__).sum() == len(tables)
    for key, node, w0 in zip(placed.key, placed.node, placed.w0):
        bits = np.unpackbits(words[node - 7].view(np.uint8), bitorder="little")[tables[key >> 48]].astype(np.int64)
        word, at = int(bits @ (1 << np.arange(len(bits)))), key & (1 << 48) - 1
        assert (word ^ at) >> 23 == 0 and (word ^ at).bit_count() <= 4 and w0 == words[node - 7].view(np.int64)[0]
