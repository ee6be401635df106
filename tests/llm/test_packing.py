"""Packing: the ids are those of the tokenizers library, every piece lies gapless in a sequence, few sequences."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm import packing
from lodestar.llm.vocabulary import encode

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
LIBRARY = Tokenizer.from_file(PATH)


def expected_pieces(rows):
    """(doc_id, piece, start, length, crc) of (doc_id, text) rows, by the library."""
    out = Counter()
    for i, t in rows:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0]
        for k, (at, n) in enumerate(packing.cut_pieces(len(ids), 2048)):
            out[i, k, at, n, zlib.crc32(np.array(ids[at : at + n], dtype="<u4").tobytes())] += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text(alphabet="ab 'sЖ😀\n\t1 <|endoftext|>", max_size=80)))
def test_ids_are_the_librarys(text):
    assert encode(text, PATH, PATTERN).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


TOKEN = "<|endoftext|>"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([TOKEN, TOKEN, "<|endoftext", "|>", " ", "\n", "\u3000", "\x1c", "a", " word", "it's", "é"]), st.text(max_size=5)), max_size=12))
def test_added_tokens_are_the_librarys(parts):
    text = "".join(parts)
    assert encode(text, PATH, PATTERN).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_long_runs_of_white_space_are_the_librarys():
    for run in (" " * 12_001, "\n" * 12_000, " \n\t" * 5_000, "\u3000\x85" * 6_000):
        for text in (run, "a" + run, run + "b", f"x{run}it's{run}1{run}", f"{TOKEN}{run}{TOKEN}{run}.", f"{run[:-1]}\x1c{run}"):
            assert encode(text, PATH, PATTERN).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_very_long_texts(spark):
    rows = [(1, " " * 2_000_000), (2, "\n" * 2_000_000), (3, "a" + " " * 1_500_000 + "b"), (4, "ab" * 300_000), (5, "word " * 400_000), (6, f"a {TOKEN} b")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), path=PATH, pattern=PATTERN).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected_pieces(rows)


def test_one_row_many_times(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(packing, "ROWS_A_BUCKET", 10)
    monkeypatch.setattr(packing, "make_plan", lambda counts, capacity, real=packing.make_plan: seen.update(counts) or real(counts, capacity))
    df = spark.range(4_000).selectExpr("cast(NULL AS long) AS doc_id", "'same text' AS text")
    packed = packing.pack_documents(df, path=PATH, pattern=PATTERN)
    assert packed.count() == 4_000 and seen == {3: 4_000}
    assert packed.groupBy("sequence_id", "offset").count().filter("count > 1").isEmpty()


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12))
def test_plan_places_every_document_once(counts):
    plan = packing.make_plan(counts, 40)
    bins = defaultdict(list)
    for length, n in counts.items():
        sequence, offset = plan.place(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            bins[s].append((o, length))
    assert len(bins) == plan.sequences
    for items in bins.values():
        at = 0
        for o, length in sorted(items):
            assert o == at
            at += length
        assert at <= 40


def test_two_smaller_ones_replace_the_smallest():
    """Greedy fills 60 + 30 and leaves 10; 30 gives way to 25 + 15."""
    plan = packing.make_plan({60: 1, 30: 1, 25: 1, 15: 1}, 100)
    sequence, _ = plan.place(np.array([60, 25, 15]), np.zeros(3, dtype=np.int64))
    assert len(set(sequence.tolist())) == 1


def test_few_sequences():
    rng = random.Random(2)
    counts = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    plan = packing.make_plan(counts)
    assert plan.sequences <= 1.002 * sum(x * n for x, n in counts.items()) / 2048 + 1


def test_documents(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "naïve", "x1", "Ωmega", "…"]) for _ in range(rng.choice([0, 3, 500, 3000, 9000]))) for _ in range(40)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no id", "x"), (50, None, "x"), (51, "", "x"), (7, texts[7], "clash"), (7, texts[7], "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = packing.pack_documents(df, path=PATH, pattern=PATTERN, with_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected_pieces([r[:2] for r in rows])
    bins = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 2048


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(df, path=PATH, pattern=PATTERN).collect() == []
