"""The driver's contract: every query runs on the smallest tables with a stable schema; SQL has the same columns."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as E
from lodestar.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert E.entry(spark).count() > 0


def rounded(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(rounded, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_and_its_sql(spark, duck, name):
    frame = catalogue.queries()[name](spark, SF)
    rows = frame.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    mine = sorted((tuple(rounded(r[c]) for c in columns) for r in rows), key=repr)
    assert mine == sorted((tuple(map(rounded, r)) for r in found.fetchall()), key=repr)
    assert os.path.isdir(SF)
