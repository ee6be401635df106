"""Main text against pages whose article is known, and the flow against all labellings of small graphs."""

from __future__ import annotations

import itertools
import random
import re
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Home of the news</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site. Please accept all of them, now and for ever.</p><button>OK</button></div>
<main><article><h1>A   title &amp; more</h1><p>First <b>para</b>graph&nbsp;here.<br>New line<p>Unclosed one.
<div class="ad">Buy this thing today, it is very good indeed and costs little.</div>
<ul><li>Item one</li><li>Item <a href="x">two</a></li></ul><p>Be.</p><aside><p>Aside text that nobody needs at all.</p></aside>
<form><label>Name</label><input name="n"><p>Fill in this form to get our letter every day.</p></form><p>Last words.</p></article>
<section id="comments"><h2>Comments</h2><article class="comment"><p>I think that this is a very good article, thank you very much.</p></article></section></main>
<div class="sidebar"><p>Most read today: a long list of other articles that people have read.</p></div>
<footer>&copy; 2024 site &middot; all rights reserved.</footer></body></html>"""


def test_page():
    assert H.main_text(PAGE) == "A title & more First paragraph here. New line Unclosed one. Item one Item two Be. Last words."


def test_page_without_semantic_elements():
    prose = "This is a sentence of the text that goes on for a while, as sentences do in articles. " * 3
    html = f'<body><div><a href="/">Home</a> <a href="/x">News</a> <a href="/y">About</a></div><div><p>{prose}</p><p>Short.</p><p>{prose}</p></div><div><a href="/p">Privacy</a> <a href="/t">Terms</a></div>'
    assert H.main_text(html) == f"{prose.strip()} Short. {prose.strip()}"


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = H.extract_text(pages).collect()
    htmls = {r.page_id: r.html for r in pages.collect()}
    assert len(got) == len(htmls)
    for r in got:
        article = re.search(r"<article>(.*)</article>", htmls[r.page_id], re.S)[1]
        inline = re.sub(r"</?b>", "", article)
        assert r.text == " ".join(" ".join(unescape(x).split()) for x in re.split(r"<[^>]+>", inline) if x.strip())


def test_edge_cases(spark):
    rows = [(1, "u", None, "x"), (1, "u", "", "x"), (None, None, "plain words only, without any markup at all, but long enough to be a text.", "x"), (2, "u", "<p>" * 3 + "a < b &am", "y"), (3, "u", "<p title='unclosed>text", "y"), (4, "u", "<article>" + "<p>word</p>" * 20_000 + "</article>", "z"), (5, "u", "<div>" * 5_000 + "<article><p>deep</p></article>", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r.text for r in H.extract_text(df).collect()}
    assert got[1, "u"] == ""
    assert got[None, None].startswith("plain words")
    assert got[4, "u"] == " ".join(["word"] * 20_000)
    assert got[5, "u"] == "deep"
    assert H.extract_text(df.limit(0)).collect() == []


MARKED = ['class="ad"', 'class="advert"', 'class="sponsor"', 'class="newsletter"', 'class="cookie-notice"', "hidden", 'style="display:none"', 'aria-hidden="true"', 'class="share-bar"', 'role="alert"']


@pytest.mark.parametrize("mark", MARKED)
@pytest.mark.parametrize("element", ["p", "h2", "blockquote", "div", "section"])
@pytest.mark.parametrize("n_words", [3, 50, 400])
def test_marked_blocks_inside_an_article(mark, element, n_words):
    kept = [f"Paragraph {k} of the article, which goes on for some more words than that." for k in range(4)]
    marked = f"<{element} {mark}>{'bought ' * n_words}today.</{element}>"
    for at in range(len(kept) + 1):
        inside = "".join([f"<p>{x}</p>" for x in kept[:at]] + [marked] + [f"<p>{x}</p>" for x in kept[at:]])
        for page in (f"<body><article>{inside}</article></body>", f"<main><div>{inside}</div></main>", f"<div class='content'>{inside}</div>"):
            assert H.main_text(page) == " ".join(kept), (at, page[:80])


@pytest.mark.parametrize("mark", MARKED)
def test_marked_items_cells_and_inline_elements(mark):
    items = ["One item of a list in the article.", "Another item of the list.", "The last item."]
    assert H.main_text("<article><ul>" + f"<li {mark}>{'bought ' * 50}</li>".join(f"<li>{x}</li>" for x in items) + "</ul></article>") == " ".join(items)
    assert H.main_text("<article><table><tr>" + f"<td {mark}>{'bought ' * 50}</td>".join(f"<td>{x}</td>" for x in items) + "</tr></table></article>") == " ".join(items)
    assert H.main_text(f"<article><p>{items[0]}</p><div {mark}><p>{'bought ' * 50}</p><ul><li>now</li></ul></div><p>{items[1]}</p></article>") == " ".join(items[:2])


@pytest.mark.parametrize("mark", ["hidden", 'style="display: none"', 'aria-hidden="true"'])
def test_hidden_inline_elements(mark):
    assert H.main_text(f"<article><p>Seen <span {mark}>not <b>seen</b> <i>at all</i></span>here.</p><p><em {mark}>Not seen.</em>Seen.</p></article>") == "Seen here. Seen."


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6))
def test_cut_is_least(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 7)
    odds = [rng.randint(-9, 9) for _ in range(n)]
    ties = [(a, b, rng.randint(1, 6)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
    flow = H.Flow(n + 2)
    for i, o in enumerate(odds):
        flow.tie(0, i + 2, max(o, 0))
        flow.tie(i + 2, 1, max(-o, 0))
    for a, b, c in ties:
        flow.tie(a + 2, b + 2, c, c)

    def cost(label):
        return sum(abs(o) for o, kept in zip(odds, label, strict=True) if o and kept != (o > 0)) + sum(c for a, b, c in ties if label[a] != label[b])

    assert cost(flow.source_side()[2:]) == min(cost(x) for x in itertools.product([False, True], repeat=n))
