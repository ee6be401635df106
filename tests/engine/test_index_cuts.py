"""Postings are cut by their keys as columns, not row by row."""

from __future__ import annotations

import pyarrow as pa

from lodestar.sources.keyword_index import _cuts


def test_cuts():
    lexeme, project = pa.array(["a", "a", "b", "b", "b", "b"]), pa.array([1, 1, 1, None, None, 2], pa.int32())
    assert _cuts([lexeme, project]) == [0, 2, 3, 5, 6]
    assert _cuts([lexeme.slice(0, 1), project.slice(0, 1)]) == [0, 1]
