"""Fill-in-the-middle forms against a direct computation over lists of units."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.llm.fill_middle import fill_in_middle, restored


def direct(doc_id, text, plain_percent=10, spm_percent=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain_percent:
        return doc_id, len(units), "plain", None, None, None, text
    if h[3] % 100 < spm_percent:
        return doc_id, len(units), "spm", pre, mid, suf, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(units), "psm", pre, mid, suf, f"<P>{pre}<S>{suf}<M>{mid}"


def fixture():
    rng = random.Random(13)
    alphabet = ["a", "Bc", " ", "\n", "é", "\x1f", "\x1a", "\x1a0", "\x1a1", "0", "1", "<", ">", "<P", "S>", "\U0001f600", "日", "$1", "\\", "\r", "\0", "\x85", " "]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 30, 200])))) for i in range(400)]
    rows += [(1000 + i, t) for i in range(30) for t in ("a <P> b", "<S>", "<M", "<<S>>", "x")]
    rows += [(2000, None), (2001, ""), (None, "one two"), (None, None), (5, rows[5][1]), (5, rows[5][1]), (2002, "ab " * 400_000), (2003, "\x1f" * 100_000), (-7, "minus seven")]
    return rows


def test_all_kinds_of_texts(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = fill_in_middle(df).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix, r.middle, r.suffix, r.output) for r in found), key=repr)
    assert got == sorted((direct(*r) for r in rows), key=repr)
    texts = {(r[0], r[1] or "") for r in rows}
    assert all((r.doc_id, r.back) in texts for r in found)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert not any(r.form != "plain" and r.prefix + r.middle + r.suffix != r.back for r in found)


@pytest.mark.parametrize(("plain", "spm"), [(0, 0), (0, 100), (100, 50)])
def test_parameters(spark, plain, spm):
    rows = [(i, f"some words {i}") for i in range(50)]
    found = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), plain_percent=plain, spm_percent=spm).collect()
    assert sorted((tuple(r) for r in found), key=repr) == sorted((direct(*r, plain, spm) for r in rows), key=repr)


def test_columns(spark):
    df = spark.createDataFrame([(1, "a b", "mine", 7)], "doc_id long, text string, form string, extra int")
    assert fill_in_middle(df).columns == ["doc_id", "extra", "n", "form", "prefix", "middle", "suffix", "output"]
    renamed = fill_in_middle(df.withColumnsRenamed({"text": "body.raw", "doc_id": "the id"}), text_col="body.raw", id_col="the id", keep=["the id"])
    assert renamed.columns[0] == "the id" and renamed.first()["n"] == 3


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_shuffle_and_no_python(spark):
    plan = fill_in_middle(spark.range(3).selectExpr("id AS doc_id", "'a b' AS text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
