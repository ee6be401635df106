"""The answer flow end to end, with the extractive provider, and the stream parser."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.ask import NO_PROJECTS, Extractive, ask, deltas, messages_for, without_thinking
from lodestar.constants import NOT_FOUND
from tests.engine.test_engine import ask as questions
from tests.engine.test_engine import corpus

DIM = 1024


def test_stream_parsing():
    lines = ['data: {"choices": [{"delta": {"content": "<th"}}]}', ": ping", 'data: {"choices": [{"delta": {"content": "ink>no</thi"}}]}', 'data: {"choices": [{"delta": {"content": "nk>yes <b"}}]}', "data: [DONE]", 'data: {"choices": [{"delta": {"content": "late"}}]}']
    assert "".join(without_thinking(deltas(lines))) == "yes <b"


def test_flow(spark):
    p = corpus(spark)
    files = p.select(F.col("chunk").alias("file"), F.lit("indexed").alias("status"))
    events = list(ask(p, questions(spark, "approve purchase order procurement module"), files, DIM, 0.45, Extractive()))
    assert [e for e, _ in events[:2]] == ["meta", "sources"] and events[-1][0] == "final"
    final = events[-1][1]
    assert final["status"] == "ok" and final["cited"] == [1] and "Approve the purchase order" in final["text"]
    events = list(ask(p, questions(spark, "weather tomorrow sunshine"), files, DIM, 0.45, Extractive()))
    assert events[-1] == ("final", {"status": "not_found", "text": NOT_FOUND, "cited": []})
    events = list(ask(p, questions(spark, "approve purchase order procurement module"), files, DIM, 0.45, Extractive(), projects=[2]))
    assert events[-1][1]["status"] == "not_found"
    events = list(ask(p, questions(spark, "approve purchase order"), files, DIM, 0.45, Extractive(), projects=[]))
    assert events[-1][1]["status"] == "no_projects"
    events = list(ask(p.limit(0), questions(spark, "anything"), files, DIM, 0.45, Extractive()))
    assert events[-1][1]["text"] == NO_PROJECTS


def test_broken_model(spark):
    class Broken:
        def stream(self, messages):
            yield "a"
            raise ConnectionError("gone")

    p = corpus(spark)
    files = p.select(F.col("chunk").alias("file"), F.lit("indexed").alias("status"))
    events = list(ask(p, questions(spark, "approve purchase order procurement module"), files, DIM, 0.45, Broken()))
    assert events[-1][0] == "error"


def test_prompt():
    assert messages_for("Why?", [("[Source: a | Page 1]", "x"), ("[Source: b | Page 2]", "y")])[1]["content"] == "Sources:\n\n[1] [Source: a | Page 1]\nx\n\n[2] [Source: b | Page 2]\ny\n\nQuestion: Why?"
