"""Dispatch by kind, broken files, pooling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestar.functions.encoders import embedding, pool
from lodestar.sources import extractors


def test_dispatch(spark, monkeypatch):
    def pdf(path, content):
        if content == b"broken":
            raise ValueError("not a pdf")
        return list(enumerate(content.decode().split("|"), 1))

    monkeypatch.setitem(extractors._registered, "pdf", pdf)
    files = [("/a/x.pdf", b"1 Intro\nbody|more"), ("/a/y.pdf", b"broken"), ("/a/n.txt", b"l1\nl2"), ("/a/m.md", "# É\nt".encode()), ("/a/p.pptx", b""), ("/a/z.exe", b"")]
    got = extractors.extract_segments(spark.createDataFrame(files, "path string, content binary")).collect()
    rows = sorted((r.path, r.loc_type, r.page, r.line_start, r.heading, r.segment) for r in got if r.error is None)
    assert rows == [("/a/m.md", "heading", None, 1, "É", "# É\nt"), ("/a/n.txt", "lines", None, 1, None, "l1\nl2"), ("/a/x.pdf", "page", 1, None, "1 Intro", "1 Intro\nbody"), ("/a/x.pdf", "page", 2, None, "1 Intro", "more")]
    assert {r.path: r.error.split(":")[0] for r in got if r.error} == {"/a/y.pdf": "ValueError", "/a/p.pptx": "NotImplementedError"}


def test_pooling_and_column(spark):
    states = np.array([[[3.0, 4.0], [1.0, 0.0]], [[0.0, 2.0], [9.0, 9.0]]])
    mask = np.array([[1, 1], [1, 0]])
    assert np.allclose(pool(states, mask, "first"), [[0.6, 0.8], [0, 1]])
    assert np.allclose(pool(states, mask, "mean"), [[2 / 8**0.5, 2 / 8**0.5], [0, 1]])
    embed = embedding(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), prefix="q: ", at_once=2)
    df = spark.createDataFrame([("a",), (None,), ("abc",)], "t string")
    assert [r[0] for r in df.select(embed(F.col("t"))).collect()] == [[4.0, 1.0], [3.0, 1.0], [6.0, 1.0]]
