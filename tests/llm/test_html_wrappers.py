"""Outside marks on what holds the article do not empty the page; what stands beside it still goes."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from lodestar.llm import html_text as H

PROSE = "This is a sentence of the text that goes on for a while, as sentences do in articles. " * 3
SIDE = "<div class='sidebar'><p>Most read today: a long list of other articles that people have read.</p></div>"
COMMENTS = f"<div id='comments'><p>{'I think that this is a very good article, thank you very much. ' * 30}</p></div>"


@pytest.mark.parametrize("before, after", [
    ("<body class='has-sidebar'>", "</body>"),
    ("<body class='no-sidebar single-post'><div>", "</div></body>"),
    ("<body><div class='elementor-widget'><div>", "</div></div></body>"),
    ("<body><div class='commentary'>", "</div></body>"),
    ("<html class='menu-open'><body>", "</body></html>"),
    ("<body><form id='aspnetForm' action='/'><div>", "</div></form></body>"),
    ("<body><form role='form'><fieldset>", "</fieldset></form></body>"),
])
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<main>{}</main>", "<div class='entry-content'>{}</div>"])
def test_wrappers(before, after, inner):
    article = inner.format(f"<p>{PROSE}</p><p>{PROSE}</p>")
    assert H.main_text(before + article + SIDE + after) == f"{PROSE.strip()} {PROSE.strip()}"


@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "<div class='entry-content'>{}</div>"])
def test_long_comments_beside_the_article_go(inner):
    assert H.main_text(f"<body class='has-sidebar'>{inner.format(f'<p>{PROSE}</p>')}{COMMENTS}</body>") == PROSE.strip()


def test_strong_marks_stay():
    hidden = f"<div style='display:none'><article><p>{PROSE}</p></article></div>"
    assert H.main_text(f"<body class='has-menu'>{hidden}<p>Seen by all who read this page, and it is enough.</p><footer><p>{PROSE * 5}</p></footer></body>") == "Seen by all who read this page, and it is enough."


@pytest.mark.parametrize("name", ["object", "canvas", "video", "audio", "svg", "select", "noscript", "iframe", "template", "math"])
def test_unclosed_elements_drop_nothing(name):
    assert H.main_text(f"<article><p>{PROSE}</p><{name} class='x'><p>{PROSE}</p><p>{PROSE}</p></article>") == " ".join([PROSE.strip()] * 3)
    assert H.main_text(f"<article><p>{PROSE}</p><{name}><p>{PROSE}</p><{name}>fallback</{name}><p>{PROSE}</p></article>").count(PROSE.strip()) == 3


def test_embedded_elements_go_and_formulas_stay():
    page = "<article><p>{0}<svg><title>icon</title></svg> where <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.</p><noscript><p>Turn scripts on.</p></noscript><select><option>one</option></select><p>{0}</p></article>"
    assert H.main_text(page.format(PROSE)) == f"{PROSE.strip()} where x=2. {PROSE.strip()}"


@pytest.mark.parametrize("opening, closing", [("<body class='has-sidebar'>", "</body>"), ("<main class='no-ads'>", "</main>"), ("<article class='post-comments-enabled'>", "</article>"), ("<div class='share-price-report'>", "</div>")])
def test_words_of_the_pages_own_elements(opening, closing):
    assert H.main_text(f"{opening}<p>{PROSE}</p><p>{PROSE}</p>{closing}") == f"{PROSE.strip()} {PROSE.strip()}"


#: Layouts without <article>: what is put around the text, and what stands beside it.
HOLDERS = [
    "<div id='content'>{}</div>", "<div class='post-body'>{}</div>", "<section>{}</section>", "<table><tr><td>{}</td></tr></table>", "<div><div><div>{}</div></div></div>",
    "<main>{}</main>", "{}", "<div class='col-8'><div class='row'>{}</div></div>", "<div role='main'>{}</div>", "<center><font>{}</font></center>",
]
TEXTS = [
    "<h1>A bridge for the town</h1><p>{0}</p><p>{0}</p>", "<h2>Minutes of the meeting</h2><p>{0}</p><ul><li>The first point was agreed by all who were there.</li><li>The second one was put off until the autumn.</li></ul><p>{0}</p>",
    "<p>{0}</p><blockquote>Nobody had asked us before, and we would have said no.</blockquote><p>{0}</p>", "{0}<br><br>{0}", "<p>{0}<p>{0}<p>Short end.",
]
BEFORE = "<nav><a href='/'>Home</a> <a href='/news'>News</a></nav><header><h1>The Daily Paper</h1></header><div class='cookie-notice'>We use cookies. <button>Accept</button></div><ul class='menu'><li><a href='/a'>Sports</a></li><li><a href='/b'>Culture</a></li></ul>"
AFTER = "<div class='related'><a href='/1'>Another article</a> <a href='/2'>One more</a></div><form><label>Your address</label><input name='e'></form><div class='sidebar'><p>Most read: a list of other things.</p></div><footer><p>Copyright 2024, all rights reserved.</p></footer>"


def test_layouts_without_article():
    """Fifty layouts; words kept that are the text's, and words of the text that are kept: 0.95 or more each."""
    prose = "The council met on Tuesday evening to speak about the new bridge, which is to be built over the river next year. Some were for it, others were worried about the noise."
    right = kept = wanted = 0
    for holder in HOLDERS:
        for text in TEXTS:
            inner = text.format(prose)
            page = f"<html><head><title>t</title></head><body>{BEFORE}{holder.format(inner)}{AFTER}</body></html>"
            expected = Counter(re.sub("<[^>]*>", " ", inner).split())
            got = Counter(H.main_text(page).split())
            right, kept, wanted = right + sum((got & expected).values()), kept + got.total(), wanted + expected.total()
    assert right / kept >= 0.95 and right / wanted >= 0.95, (right / kept, right / wanted)
