"""Answering one question: retrieve, gate, pack, generate, check. The plan is one batch; only generation is outside it.

``ask`` yields (event, data) pairs: meta, sources, token (many), then final, or error at any point. What generates is
a provider with ``stream(messages)``; ``Extractive`` works without a model, ``HttpChat`` speaks to a server that
streams chat completions.
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Iterable, Iterator, Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.constants import NOT_FOUND, RELATED_SIMILARITY, STOP_WORDS
from lodestar.functions.text import estimated_tokens, location_label, snippet, source_header
from lodestar.lineage import written
from lodestar.operators import search
from lodestar.operators.answers import checked

SYSTEM_PROMPT = (
    "Answer questions about our projects from the numbered sources of the user's message only. State nothing that they do not say. "
    f"If they do not hold the answer, reply with exactly this sentence: {NOT_FOUND} "
    "Put the number of its source in square brackets after every fact, for example [1]. Copy code as it stands, in a code block. Be brief."
)
NO_PROJECTS = "No document folders are available to you yet. An administrator can add one under Settings."


class Provider(Protocol):
    def stream(self, messages: list[dict[str, str]]) -> Iterable[str]: ...


def content_words(text: str) -> set[str]:
    return {w for w in re.findall("[a-z0-9]{3,}", text.lower()) if w not in STOP_WORDS}


class Extractive:
    """Quotes, of every source, the sentence that shares most words with the question."""

    def stream(self, messages: list[dict[str, str]]) -> Iterator[str]:
        sources, _, question = messages[-1]["content"].rpartition("\n\nQuestion: ")
        wanted = content_words(question)
        for n, block in enumerate(sources.removeprefix("Sources:\n\n").split("\n\n["), 1):
            body = block.split("\n", 1)[-1]
            best = max(re.split(r"(?<=[.!?])\s+|\n+", body), key=lambda s: len(content_words(s) & wanted), default="")
            if content_words(best) & wanted:
                yield f"{best.rstrip('.!?')} [{n}]. "


class HttpChat:
    """Chat completions as server-sent events; what a model thinks before it answers is left out."""

    def __init__(self, url: str, model: str, key: str | None = None, timeout: float = 120.0):
        self.url, self.model, self.key, self.timeout = url, model, key, timeout

    def stream(self, messages: list[dict[str, str]]) -> Iterator[str]:
        body = json.dumps({"model": self.model, "messages": messages, "stream": True}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as reply:
            yield from without_thinking(deltas(line.decode() for line in reply))


def deltas(lines: Iterable[str]) -> Iterator[str]:
    """The pieces of text in a stream of events, up to its end mark."""
    for line in lines:
        if not line.startswith("data:"):
            continue
        data = line[5:].strip()
        if data == "[DONE]":
            return
        choices = json.loads(data).get("choices") or [{}]
        if piece := (choices[0].get("delta") or {}).get("content"):
            yield piece


def without_thinking(pieces: Iterable[str]) -> Iterator[str]:
    """The text outside <think> elements, whose tags may be cut anywhere."""
    held, inside = "", False
    for piece in pieces:
        held += piece
        while True:
            tag = "</think>" if inside else "<think>"
            at = held.find(tag)
            if at >= 0:
                if not inside and at:
                    yield held[:at]
                held, inside = held[at + len(tag) :], not inside
                continue
            keep = next((n for n in range(min(len(tag) - 1, len(held)), 0, -1) if tag.startswith(held[-n:])), 0)
            if not inside and len(held) > keep:
                yield held[: len(held) - keep]
            held = held[len(held) - keep :] if keep else ""
            break
    if held and not inside:
        yield held


def messages_for(question: str, blocks: list[tuple[str, str]]) -> list[dict[str, str]]:
    """The prompt: numbered (header, text) sources, then the question."""
    sources = "\n\n".join(f"[{i}] {header}\n{text}" for i, (header, text) in enumerate(blocks, 1))
    return [{"role": "system", "content": SYSTEM_PROMPT}, {"role": "user", "content": f"Sources:\n\n{sources}\n\nQuestion: {question}"}]


def ask(
    passages: DataFrame, question: DataFrame, files: DataFrame, dim: int, threshold: float, provider: Provider, context_length: int = 4_096, projects: Sequence[int] | None = None
) -> Iterator[tuple[str, dict]]:
    """Events of one answer to ``question``, which is one row, from the passages of the projects that the user may see.

    Passages may have file, file_name and page: then headers say so, and a sample goes on over the pages of its section.
    """
    asked = question.first()
    yield "meta", {"question": asked["text"]}
    passages = search.of_projects(passages, projects)
    if passages.isEmpty():
        yield "final", {"status": "no_projects", "text": NO_PROJECTS, "cited": []}
        return
    found = search.ranked_lists(passages, question, dim)[:2]
    (vector, _), (keyword, _) = [(written(hits.select("question", "chunk", "score", "rank")), weight) for hits, weight in found]
    relevant = search.gate(question, vector, keyword, threshold).first()["relevant"]
    optional = {"file": F.col("chunk"), "file_name": F.lit("page.pdf"), "page": F.col("chunk")}
    about = passages.select("chunk", "heading", "text", *[(F.col(n) if n in passages.columns else other).alias(n) for n, other in optional.items()])
    hits = search.retrieve(passages, question, files, dim, lists=(vector, keyword)).join(about, "chunk")
    label = location_label(F.lit("page"), page=F.col("page"))
    hits = hits.withColumn("header", source_header(F.col("file_name"), label, F.col("heading"))).withColumn("snippet", snippet(F.col("text")))
    if not relevant:
        near = [r for r in hits.orderBy("rank").limit(3).collect() if (r["similarity"] or 0.0) >= RELATED_SIMILARITY]
        yield "sources", {"sources": [{"n": i, "chunk": r["chunk"], "snippet": r["snippet"], "cited": False} for i, r in enumerate(near, 1)]}
        yield "final", {"status": "not_found", "text": NOT_FOUND, "cited": []}
        return
    prompt = estimated_tokens(F.lit(SYSTEM_PROMPT + asked["text"]))
    kept = search.pack(hits, context_length, prompt).orderBy("rank").collect()  # at most the top k
    yield "sources", {"sources": [{"n": i, "chunk": r["chunk"], "snippet": r["snippet"], "cited": False} for i, r in enumerate(kept, 1)]}
    pieces = []
    try:
        for piece in provider.stream(messages_for(asked["text"], [(r["header"], r["text"]) for r in kept])):
            pieces.append(piece)
            yield "token", {"t": piece}
    except OSError as e:
        yield "error", {"message": f"The model does not respond: {e}"}
        return
    spark = passages.sparkSession
    places = spark.createDataFrame([(i, r["file"], r["heading"], r["page"]) for i, r in enumerate(kept, 1)], "place int, file string, section string, page long")
    after = {r["place"]: r["next_place"] for r in search.next_pages(places).collect()}
    row = spark.createDataFrame([("".join(pieces), asked["text"], [r["text"] for r in kept], after)], "answer string, question string, sources array<string>, after map<int,int>")
    answer = checked(row, ["question"]).first()
    cards = [{"n": i, "chunk": r["chunk"], "snippet": r["snippet"], "cited": i in answer["cited"]} for i, r in enumerate(kept, 1)]
    status = "not_found" if answer["not_found"] else "ok"
    yield "final", {"status": status, "text": answer["text"], "cited": answer["cited"], "uncited": status == "ok" and not answer["cited"], "code_changes": answer["code_changes"], "sources": cards[:3] if answer["not_found"] else cards}
