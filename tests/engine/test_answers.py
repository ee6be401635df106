"""Literal expectations for markers, grounding, support, code samples, sections and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.constants import NOT_FOUND
from lodestar.functions.answer_text import grounded, tidied
from lodestar.functions.code_blocks import NO_SAMPLE, guarded
from lodestar.functions.text import fallback_tokens, terms
from lodestar.operators import answers as A
from lodestar.operators import chunking as C

SOURCES = [
    "Open Procurement, choose Pending Orders, select the purchase order and press Approve to release the order.",
    "Payroll exports run monthly; the finance department reviews every salary statement before the bank transfer.",
    "The archive keeps scanned invoices for ten years and deletes temporary uploads every night.",
]


def check(spark, answer, sources=SOURCES, question=None, after=None):
    rows = spark.createDataFrame([(1, answer, question, sources, after or {})], "id int, answer string, question string, sources array<string>, after map<int,int>")
    return A.checked(rows, ["id"]).first()


def tidy(spark, answer, n):
    return spark.createDataFrame([(answer,)], "a string").select(tidied(F.col("a"), F.lit(n))).first()[0]


def guard(spark, answer, sources, question, after=None):
    rows = spark.createDataFrame([(answer, question, sources, after or {})], "a string, q string, s array<string>, f map<int,int>")
    found = rows.select(guarded(F.col("a"), F.col("s"), F.col("q"), F.col("f")).alias("g")).first().g
    return found.text, found.changes


def test_markers_are_normalised(spark):
    assert tidy(spark, "One fact [1, 3]. Another [Source 2].", 3) == "One fact [1][3]. Another [2]."
    got = check(spark, "One fact [1, 3]. Another [Source 2].", ["a", "b", "c"], None)
    assert got.invalid == [] and A.__all__


def test_invalid_markers_go(spark):
    assert tidy(spark, "A fact [7] . Two  spaces [0] here [2][2, 2].", 2) == "A fact. Two spaces here [2][2]."
    got = check(spark, "A fact [7] . Two  spaces [0] here [99999999999].", [])
    assert got.text == "A fact. Two spaces here." and set(got.invalid) == {7, 0, 2**31 - 1} and got.supported == 1.0 and not got.not_found


def test_misplaced_marker_moves_and_missing_one_is_added(spark):
    got = check(spark, "Select the purchase order in Pending Orders and press Approve [2].")
    assert got.text.endswith("press Approve [1].") and got.regrounded == 1 and got.cited == [1]
    got = check(spark, "- Finance reviews every salary statement before the transfer. Yes.")
    assert got.text == "- Finance reviews every salary statement before the transfer [2]. Yes." and got.regrounded == 1


def test_marker_after_the_full_stop_and_in_code(spark):
    rows = spark.createDataFrame([("Select the purchase order and press Approve. [1]\n```\ncall(x) [1]\n```\nThe archive keeps scanned invoices for ten years.", SOURCES)], "a string, s array<string>")
    got = rows.select(grounded(F.col("a"), F.transform("s", terms)).alias("g")).first().g
    assert got.text == "Select the purchase order and press Approve [1].\n```\ncall(x)\n```\nThe archive keeps scanned invoices for ten years [3]." and got.changes == 1


def test_general_knowledge_hedged_and_off_topic_answers_are_replaced(spark):
    assert check(spark, "Photosynthesis converts sunlight into chemical energy inside green leaves.").text == NOT_FOUND
    assert check(spark, "The documents do not mention this. Select the purchase order and press Approve.").not_found
    assert check(spark, "Refresh the purchase order, select Approve in Pending Orders of Procurement.", question="How to refresh tokens?").not_found
    good = check(spark, "Open Procurement, choose Pending Orders and press Approve [1].", question="How are orders approved?")
    assert not good.not_found and good.supported == 1.0


def test_nulls_and_empty_answers(spark):
    rows = spark.createDataFrame([(1, None, None, None), (2, "", "", []), (3, "x [1].", None, [None, "y"])], "id int, answer string, question string, sources array<string>")
    assert [(r.id, r.text, r.cited, r.not_found) for r in A.checked(rows, ["id"]).orderBy("id").collect()] == [(1, "", [], False), (2, "", [], False), (3, "x [1].", [1], False)]


SAMPLE = ["12\nIntroduction to the service.", "Sample API Call\nclient = Connect(url)\nresult = client.ChangeAddress(id, mail)\nIF result THEN RETURN\nError Handling\nnothing", "ChangeAddress(\n  id, mail\n) : Boolean\nvalues = {a: 1};\nx = (1);"]


def test_code_is_quoted_or_replaced(spark):
    real = "```\nclient = Connect(url)\nresult = client.ChangeAddress(id, mail)\n```"
    assert guard(spark, real, SAMPLE, "show code") == (real, 0)
    text, n = guard(spark, "```python\nimport x\n```\n```js\nlet y\n```", SAMPLE, "sample code for ChangeAddress")
    assert n == 2 and "The documents show this sample [2]:" in text and "above [2]" in text and "Error Handling" not in text
    assert "The documents define the method as [3]:" in text and "ChangeAddress(\n  id, mail\n) : Boolean" in text
    assert guard(spark, "```\nfoo()\n```", ["plain prose"], "why?") == (NO_SAMPLE, 1)
    text, n = guard(spark, "It works like this.", SAMPLE, "How do I call it?")
    assert n == 1 and text.startswith("It works like this.\n\n")


def test_three_altered_blocks_have_one_sample(spark):
    text, n = guard(spark, "```\na1\n```\n```\nb2\n```\n```\nc3\n```", SAMPLE, "sample")
    assert n == 3 and text.count("The documents show this sample") == 1 and text.count("_See the sample from the documents above") == 2 and text.count("define the method") == 1


def test_sample_goes_on_over_the_page(spark):
    sources = ["Step 1\na = b(c)\nd = e(f)\ng = h(i)", "7\nStep 2\nj = k(l)\nm = n(o)\nresult = service.finish(order, amount)\nNotes\nend"]
    text, _ = guard(spark, "```\nbad\n```", sources, "code", {1: 2})
    assert "[1][2]" in text and "j = k(l)" in text and "Notes" not in text and "\n7\n" not in text
    assert guard(spark, "```\nbad\n```", sources, "code", {1: 9, 2: 2})[1] == 1


def sections(spark, pages, outline=None):
    p = spark.createDataFrame([(1, k, t) for k, t in pages], "id int, page int, text string")
    o = None if outline is None else spark.createDataFrame([(1, k, i, level, t) for k, marks in outline.items() for i, (level, t) in enumerate(marks)], "id int, page int, place int, level int, title string")
    return [(r.page, r.section, r.text) for r in C.numbered_sections(p, o).orderBy("place").collect()]


def test_sections_follow_numbers(spark):
    got = sections(spark, [(1, "Intro text"), (2, "3 Authentication\nbody\n3.1\nRequestToken\nmore"), (3, "carried on\n2 Backward\n41 Far"), (4, None)])
    assert [(p, s) for p, s, _ in got] == [(1, None), (2, "3 Authentication"), (2, "3 Authentication › 3.1 RequestToken"), (3, "3 Authentication › 3.1 RequestToken")]
    assert sections(spark, [(1, "1. Returns True.\n9.3 X ..... 142")]) == [(1, None, "1. Returns True.\n9.3 X ..... 142")]
    assert sections(spark, [(1, ".... " * 5)])[0][1] == "Contents"
    assert [s for _, s, _ in sections(spark, [(1, "3 A b\n3.2 C d\n3.10 E f\n4 G h\n4.1.1 I j\n5 K l")])] == ["3 A b", "3 A b › 3.2 C d", "3 A b › 3.10 E f", "4 G h", "4 G h › 4.1.1 I j", "5 K l"]


def test_bookmarks_take_precedence(spark):
    outline = {1: [(1, "A"), (2, "B")], 3: [(1, "C")], 4: [(3, "deep")], 9: [(1, "beyond")]}
    assert [s for _, s, _ in sections(spark, [(1, "x"), (2, "2 Number\ny"), (3, "z"), (4, "w")], outline)] == ["A › B", "A › B", "C", "C › deep"]


def chunked(spark, text, most=450, overlap=50):
    rows = C.chunks(spark.createDataFrame([(1, text)], "id int, segment string"), ["id"], most=most, overlap=overlap)
    return [(r.text, r.tokens) for r in rows.orderBy("piece").collect()]


def test_chunks_overlap_within_limits(spark):
    got = chunked(spark, "\n\n".join(f"Paragraph {k} " + "word " * 40 for k in range(40)), 120, 60)
    assert len(got) > 2 and all(n <= 120 for _, n in got)
    assert got[0][0].split("\n\n")[-1] == got[1][0].split("\n\n")[0]
    assert all(n <= 450 for _, n in chunked(spark, "one " * 2_000))
    tokens = spark.createDataFrame([(4,), (15,), (45,)], "n int").select(fallback_tokens(F.repeat(F.lit("w "), F.col("n")))).collect()
    assert [r[0] for r in tokens] == [5, 20, 58]
    assert chunked(spark, "") == [] and chunked(spark, None) == []


def test_file_chunks_are_numbered_and_have_content(spark):
    segments = [(1, "a.pdf", 0, "page", 3, None, None, "2 Methods", "2 Methods"), (1, "a.pdf", 1, "page", 4, None, None, "2 Methods", "Body of the section."), (1, "a.pdf", 2, "page", 5, None, None, None, "6"), (1, "a.pdf", 3, "page", 6, None, None, None, "Last page here."), (2, "b.txt", 0, "lines", None, 1, 9, None, "Some lines.")]
    rows = spark.createDataFrame(segments, "file_id int, file_name string, place int, loc_type string, page int, line_start int, line_end int, heading string, segment string")
    got = sorted((r.file_id, r.ordinal, r.header, r.text) for r in C.file_chunks(rows, "multilingual-e5-small").collect())
    assert got == [(1, 0, "[Source: a.pdf | Page 4 | 2 Methods]", "Body of the section."), (1, 1, "[Source: a.pdf | Page 6]", "Last page here."), (2, 0, "[Source: b.txt | Lines 1–9]", "Some lines.")]
    assert C.limit_of("multilingual-e5-small") == 448 and C.limit_of("bge-m3") == 450
