"""Extractors by kind of file, and the plan that sends every file through its own.

An extractor is a function from (path, bytes) to segments. Text and Markdown are made by plans (``sources.segments``);
for PDF and Office files a program has to be at hand: ``register`` adds one. Files of a kind without an extractor, and
files that an extractor fails on, come out with an error instead of segments; the others are not held up by them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.constants import SLIDE_EXTS
from lodestar.functions.files import extension, kind_of
from lodestar.lineage import written
from lodestar.operators.chunking import numbered_sections
from lodestar.sources.folders import decode
from lodestar.sources.segments import markdown_sections, text_windows

Pages = list[tuple[int, str]]
_registered: dict[str, Callable[[str, bytes], Pages]] = {}


def register(kind: str, extract: Callable[[str, bytes], Pages]) -> None:
    """Use a function from (path, bytes) to (page number, text) rows for a kind: pdf or office."""
    _registered[kind] = extract


def _pages(extract: Callable[[str, bytes], Pages] | None, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    if extract is None:
                        raise NotImplementedError(f"no extractor for {kind} files")
                    out += [{"id": path, "page": p, "text": t} for p, t in extract(path, content)]
                except Exception as e:  # one broken file must not stop the rest; what is wrong is in its row
                    out.append({"id": path, "error": f"{type(e).__name__}: {e}"[:2_000]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("id", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("error", pa.string())]))

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(b.as_py() or b"") for b in batch.column(1)], pa.string())], names=["path", "text"])


def extract_segments(files: DataFrame) -> DataFrame:
    """Files (path, content) -> (path, loc_type, page, line_start, line_end, heading, segment, error): every kind by its own plan."""
    name = F.element_at(F.split("path", "/"), -1)
    typed = files.select("path", "content", kind_of(name).alias("kind"), extension(name).alias("ext"))
    texts = typed.where("kind = 'text'").select("path", "content", "ext")
    plain = texts.where("ext = '.txt'").select("path", "content").mapInArrow(_texts, "path string, text string")
    marked = texts.where("ext <> '.txt'").select("path", "content").mapInArrow(_texts, "path string, text string")
    empty = lambda t: F.lit(None).cast(t)
    parts = [
        text_windows(plain).select("path", F.lit("lines").alias("loc_type"), empty("int").alias("page"), "line_start", "line_end", empty("string").alias("heading"), "segment", empty("string").alias("error")),
        markdown_sections(marked).select("path", "loc_type", empty("int").alias("page"), "line_start", "line_end", "heading", "segment", empty("string").alias("error")),
    ]
    for kind in ("pdf", "office"):
        pages = written(typed.where(F.col("kind") == kind).select("path", "content").mapInArrow(_pages(_registered.get(kind), kind), "id string, page int, text string, error string"))
        place = F.when(F.lower("id").rlike("(" + "|".join(SLIDE_EXTS).replace(".", r"\.") + ")$"), "slide").otherwise("page")
        parts.append(numbered_sections(pages.where("error IS NULL")).select(F.col("id").alias("path"), place.alias("loc_type"), "page", empty("int").alias("line_start"), empty("int").alias("line_end"), F.col("section").alias("heading"), F.col("text").alias("segment"), empty("string").alias("error")))
        parts.append(pages.where("error IS NOT NULL").select(F.col("id").alias("path"), empty("string").alias("loc_type"), empty("int").alias("page"), empty("int").alias("line_start"), empty("int").alias("line_end"), empty("string").alias("heading"), empty("string").alias("segment"), "error"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
