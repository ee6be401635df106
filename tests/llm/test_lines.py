"""Line dedup against a direct computation."""

from __future__ import annotations

import random

import pytest

from lodestar.llm import lines
from lodestar.llm.lines import dedup_lines

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def direct(rows, min_chars=40, min_docs=5):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(SPACES).translate(LOWER)
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(i)
    often = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        rest = [x for x in all_lines if (k := x.strip(SPACES).translate(LOWER)) not in often or often[k] == i]
        out.append((i, len(all_lines), len(all_lines) - len(rest), "\n".join(rest)))
    return sorted(out, key=repr)


def found(df, **parameters):
    return sorted((tuple(r) for r in dedup_lines(df, **parameters).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=repr)


def fixture(seed):
    rng = random.Random(seed)
    stock = ["x" * 39, "y" * 40, "é" * 40, "Ä long line with CAPITALS and Umlauts ÄÖÜ in it", "z" * 3000, "tail  " + "w" * 40, "short", "", "   ", "\U0001f600" * 40]
    stock += [f"a common line number {k} that is long enough to count" for k in range(12)]
    rows = []
    for i in range(60):
        picked = []
        for _ in range(rng.choice([0, 1, 3, 12])):
            line = rng.choice(stock) if rng.random() < 0.7 else f"a line of its own {rng.random()} and then some more words"
            line = line.upper() if rng.random() < 0.2 and line.isascii() else line
            picked.append(rng.choice(["", " ", "\t\r", "\x0b\x0c"]) + line + rng.choice(["", " ", "\r", " "]))
        rows.append((i, "\n".join(picked)))
    rows += [(100, None), (101, ""), (102, "\n"), (None, rows[3][1]), (None, rows[9][1]), (None, rows[3][1]), (7, rows[7][1]), (7, rows[8][1]), (7, rows[7][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_documents_and_edge_cases(spark, seed):
    rows = fixture(seed)
    expected = direct(rows)
    assert any(r[2] for r in expected)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == expected


def test_joined_where_a_broadcast_would_be_too_large(spark, monkeypatch):
    monkeypatch.setattr(lines, "MOST_BROADCAST", -1)
    rows = fixture(4)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == direct(rows)


def test_parameters(spark):
    rows = [(i, f"shared\nalone {i}\nSHARED") for i in range(3)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=6, min_docs=3) == direct(rows, 6, 3) == [(0, 3, 2, "alone 0"), (1, 3, 2, "alone 1"), (2, 3, 0, "shared\nalone 2\nSHARED")]


def test_one_document_holds_nothing_but_a_line_many_times(spark):
    """One id does not count more than once, however many rows and lines it has."""
    line = "a line that is certainly long enough to be counted"
    rows = [(1, "\n".join([line] * 9))] * 9 + [(None, line)] * 9
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == direct(rows)
    rows += [(2, line), (3, line)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == direct(rows)
    rows += [(4, line)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == direct(rows)


def test_a_very_long_text(spark):
    common = [f"common line {k} that is long enough, really, to be counted" for k in range(2_000)]
    long_text = "\n".join(x for k in range(100_000) for x in ([common[k % 2_000]] if k % 3 == 0 else [f"own line {k} of a very long text that is its own and long"]))
    rows = [(0, long_text)] + [(i, "\n".join(common)) for i in range(1, 6)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == direct(rows)


def test_columns(spark):
    df = spark.createDataFrame([(1, "a", "mine", 7)], "doc_id long, text string, n_lines string, extra int")
    assert dedup_lines(df).columns == ["doc_id", "extra", "n_lines", "n_dropped", "kept_text"]
    renamed = df.withColumnsRenamed({"text": "body.raw", "doc_id": "the id"})
    assert dedup_lines(renamed, text_col="body.raw", id_col="the id", keep=["the id"]).first()["n_lines"] == 1


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []
