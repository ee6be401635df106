"""Main text of web pages by minimum-cut labelling.

A page is divided into blocks (text between block-level tags). A classifier gives every block log-odds of being
content, from where it stands (elements, roles, class and id words of its ancestors), how much of it is links, its
length and punctuation. Those become the capacities to the two terminals; neighbouring blocks and blocks that follow
each other under one parent are tied by smoothness edges. A maximum flow then separates content from boilerplate.

What is marked as outside the article is not tied to what is not: an advert between two paragraphs of an article is an advert
whatever stands around it. Inline elements that are hidden have no text.

The classifier's weights are parameters (``Weights``), set by hand: there are no labelled pages to fit them to.

Where an element stands is evidence of its words, not of the whole page: html and body are never marked as outside, nor is
by its class, id or as a form an element that holds the page's main part (see ``lifted_marks``).

Pages are independent of each other and are read whole, one at a time; a page's graph has a few edges per block.

Defined results: null and empty html have empty text; repeated rows and null ids are rows like any others; markup that
is cut off or not closed is read as browsers do in the main (an open paragraph ends at the next block); an empty table
gives an empty result; input columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content is no markup (to the end of the page if they are not closed), and those that hold no text of the
#: page (dropped up to their end tag; an unclosed one drops nothing).
RAW = frozenset("script style textarea title xmp noembed noframes".split())
EMBEDDED = frozenset("template noscript iframe svg object select canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPH_ENDS = BLOCK - frozenset("br button label option summary".split())
OUTSIDE = frozenset("nav footer aside form menu dialog button fieldset label".split())
INSIDE = frozenset("article main".split())
#: Elements that hold the whole page and say nothing of it, and those that may be wrapped around all of it.
WHOLE = frozenset("html body".split())
FORMS = frozenset("form fieldset".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
INSIDE_ROLES = frozenset("main article".split())
#: Words of class and id attributes that mark what is not the article, by their beginnings; and some that must be whole.
OUTSIDE_WORDS = re.compile(
    r"(?:advert|sponsor|promo|banner|sidebar|sidenav|navbar|navigation|breadcrumb|footer|masthead|cookie|consent|gdpr|notice|notif|popup|modal|overlay"
    r"|newsletter|subscri|share|sharing|social|related|recommend|comment|repl(?:y|ies)|disqus|respond|discussion|widget|login|signup|signin|paginat|pager|copyright|toolbar|menu|skyscraper|outbrain|taboola)"
    r"|(?:ad|ads|adv|nav|aside|alert|form|search|header|topbar|tags|legal|disclaimer|hidden|toc)$"
)
INSIDE_WORDS = frozenset("article content entry post story main body text prose".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
TAG = re.compile(r"<(?:!--(?:.*?)(?:-->|\Z)|[!?][^>]*>|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
MAIN_ROLE = re.compile(r"role\s*=\s*[\"']?main\b", re.I)
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass(frozen=True)
class Weights:
    """Log-odds of content that each finding adds, and the ties between blocks."""

    outside: float = -6.0
    inside: float = 4.0
    unmarked: float = -0.5
    links: float = -4.0
    word: float = 0.06
    most_words: float = 2.5
    sentence: float = 0.7
    paragraph: float = 0.6
    heading: float = 0.4
    neighbour: float = 0.5
    sibling: float = 1.0


@dataclass
class Element:
    name: str
    mark: int  # -1 outside the article, 1 inside, 0 says nothing; inherited from the nearest ancestor that says something
    number: int
    unseen: bool = False  # an inline element that is hidden


@dataclass
class Block:
    parent: int
    name: str
    mark: int
    pieces: list[str] = field(default_factory=list)
    link_chars: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


def values_of(attributes: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}


def is_hidden(values: dict[str, str]) -> bool:
    return "hidden" in values or values.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I))


def mark_of(name: str, attributes: str, inherited: int, lifted: bool = False) -> int:
    """Whether an element lies inside or outside the article: its class, id and role, then its name, then its parent.

    ``lifted`` leaves out what may also be said of the whole page: outside words, and being a form.
    """
    if name in WHOLE:
        return inherited
    if attributes and "=" in attributes or "hidden" in attributes:
        values = values_of(attributes)
        if is_hidden(values):
            return -1
        role = values.get("role", "").lower()
        if role in OUTSIDE_ROLES and not (lifted and role == "form"):
            return -1
        if role in INSIDE_ROLES:
            return 1
        words = [w.lower() for key in ("class", "id") if key in values for w in WORD.findall(values[key])]
        if words:
            within = INSIDE_WORDS.intersection(words)
            outside = [w for w in words if OUTSIDE_WORDS.match(w)]
            if not lifted and outside and not (within and all(w in ("header", "tags", "notice", "toc") for w in outside)):
                return -1
            if within and inherited >= 0 and (name not in OUTSIDE or lifted and name in FORMS):
                return 1
    if name in OUTSIDE and not (lifted and name in FORMS):
        return -1
    if name == "header":
        return inherited if inherited > 0 else -1
    if name in INSIDE:
        return inherited if inherited < 0 else 1
    return inherited


@dataclass
class Place:
    """What the first reading of a page notes of an element."""

    parent: int
    soft: bool  # outside only by words or as a form
    strong: bool  # outside by itself or an ancestor, whatever its words say
    core: int  # 3 a main element, 2 an article, 1 marked as content by its words
    chars: int = 0  # text outside links, with all below


def lifted_marks(places: Sequence[Place]) -> frozenset[int]:
    """Elements whose outside mark is not believed, as the page's core or most of its text is within them.

    The core is the largest main element, or else article, or else element with a content class.
    """
    if not any(p.soft for p in places):
        return frozenset()
    for p in reversed(places[1:]):
        places[p.parent].chars += p.chars
    cores = [k for k, p in enumerate(places) if p.core and not p.strong and p.chars]
    if cores:
        at = max(cores, key=lambda k: (places[k].core, places[k].chars))
        within = set()
        while at:
            within.add(at)
            at = places[at].parent
    else:
        within = {k for k, p in enumerate(places) if 2 * p.chars > places[0].chars}
    return frozenset(k for k in within if places[k].soft)


@cache
def raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)


@cache
def either_tag(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I)


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page that have text, in page order; it is read again if marks are lifted."""
    places = [Place(0, False, False, 0)]
    out = _read(html, frozenset(), places)
    lifted = lifted_marks(places)
    return _read(html, lifted, None) if lifted else out


def _read(html: str, lifted: frozenset[int], places: list[Place] | None) -> list[Block]:
    out: list[Block] = []
    stack = [Element("", 0, 0)]
    count = at = links = unseen = 0
    now: Block | None = None

    def say(raw: str) -> None:
        nonlocal now
        if not raw or unseen:
            return
        text = unescape(raw) if "&" in raw else raw
        if now is None:
            if not text.strip():
                return
            # the parent that a block has in common with its siblings is the one above its own element
            own = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name in BLOCK), 0)
            holder = stack[own - 1] if stack[own].name in ("p", "li", "td", "th", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre") and own else stack[own]
            now = Block(holder.number, stack[own].name, stack[-1].mark)
        now.pieces.append(text)
        if links:
            now.link_chars += len(text.strip())
        elif places is not None:
            places[stack[-1].number].chars += len(text.strip())

    def flush() -> None:
        nonlocal now
        if now is not None:
            out.append(now)
            now = None

    ahead: dict[str, re.Match | None] = {}

    def next_tag(name: str, after: int) -> re.Match | None:
        """The next start or end tag of this name; what was found is kept, so that a page is searched once for each name."""
        if name not in ahead or (known := ahead[name]) is not None and known.start() < after:
            ahead[name] = either_tag(name).search(html, after)
        return ahead[name]

    def pop(to: int) -> None:
        nonlocal links, unseen
        for e in stack[to:]:
            links -= e.name == "a"
            unseen -= e.unseen
        del stack[to:]

    while True:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        m = TAG.match(html, lt) or LOOSE_TAG.match(html, lt)
        if not m:
            say(html[at : lt + 1])
            at = lt + 1
            continue
        say(html[at:lt])
        at = m.end()
        if not m[2]:
            continue
        closing, name, attributes = m[1], m[2].lower(), m[3]
        if name in BLOCK:
            flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    pop(k)
                    break
                if name not in BLOCK and stack[k].name in BLOCK:
                    break  # the end of an inline element does not reach over a block's
            continue
        if name in RAW:
            end = raw_end(name).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in EMBEDDED:
            if not attributes.rstrip().endswith("/") and (end := next_tag(name, at)) is not None and end[1]:
                at = end.end()
            continue
        if name in VOID:
            continue
        if name in PARAGRAPH_ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    pop(k)
                    break
                if stack[k].name in BLOCK:
                    break
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in closes:
                    pop(k)
                    break
                if stack[k].name in ("ul", "ol", "dl", "table", "menu", "dir") or name != "tr" and stack[k].name == "tr":
                    break
        count += 1
        if places is not None:
            above = stack[-1].number
            own = mark_of(name, attributes, 0)
            strong = own < 0 and mark_of(name, attributes, 0, True) < 0
            core = 0 if own < 1 else 3 if name == "main" or MAIN_ROLE.search(attributes) else 2 if name == "article" else 1
            places.append(Place(above, own < 0 and not strong, strong or places[above].strong, core))
        inline = bool(attributes) and name not in BLOCK and is_hidden(values_of(attributes))
        stack.append(Element(name, mark_of(name, attributes, stack[-1].mark, count in lifted), count, inline))
        links += name == "a"
        unseen += inline
    flush()
    return [b for b in out if b.text]


def log_odds(block: Block, w: Weights) -> float:
    text = block.text
    value = {-1: w.outside, 0: w.unmarked, 1: w.inside}[block.mark]
    value += w.links * min(1.0, block.link_chars / len(text)) + min(w.most_words, w.word * (text.count(" ") + 1))
    value += w.sentence * (text[-1] in ".!?…\"'»”") + w.paragraph * (block.name in ("p", "blockquote", "pre")) + w.heading * (block.name in ("h1", "h2", "h3"))
    return value


class Flow:
    """Maximum flow by shortest augmenting levels; nodes 0 and 1 are the terminals."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def tie(self, a: int, b: int, there: int, back: int = 0) -> None:
        for x, y, capacity in ((a, b, there), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(capacity)

    def levels(self) -> list[int]:
        level = [-1] * len(self.out)
        level[0] = 0
        queue = deque([0])
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self) -> list[bool]:
        while (level := self.levels())[1] >= 0:
            next_edge = [0] * len(self.out)
            path: list[int] = []
            x = 0
            while True:
                if x == 1:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    k = next(k for k, e in enumerate(path) if not self.room[e])
                    x = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while next_edge[x] < len(self.out[x]):
                    e = self.out[x][next_edge[x]]
                    if self.room[e] and level[self.to[e]] == level[x] + 1:
                        break
                    next_edge[x] += 1
                else:
                    if not path:
                        break
                    e = path.pop()
                    x = self.to[e ^ 1]
                    next_edge[x] += 1
                    continue
                path.append(e)
                x = self.to[e]
        return [v >= 0 for v in level]


def label_blocks(blocks: Sequence[Block], w: Weights) -> list[bool]:
    """Which blocks are content: the source side of the minimum cut."""
    flow = Flow(len(blocks) + 2)
    last: dict[tuple[int, bool], int] = {}
    for i, b in enumerate(blocks):
        odds = round(1000 * log_odds(b, w))
        if odds > 0:
            flow.tie(0, i + 2, odds)
        elif odds < 0:
            flow.tie(i + 2, 1, -odds)
        outside = b.mark < 0
        if i and (blocks[i - 1].mark < 0) == outside:
            flow.tie(i + 1, i + 2, round(1000 * w.neighbour), round(1000 * w.neighbour))
        if (b.parent, outside) in last:
            flow.tie(last[b.parent, outside] + 2, i + 2, round(1000 * w.sibling), round(1000 * w.sibling))
        last[b.parent, outside] = i
    return flow.source_side()[2:]


def main_text(html: str | None, weights: Weights = Weights()) -> str:
    blocks = blocks_of(html or "")
    return " ".join(b.text for b, kept in zip(blocks, label_blocks(blocks, weights), strict=True) if kept)


def _extract(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([main_text(h.as_py(), weights) for h in batch.column(0)], pa.string())], names=["row", "text"])

    return run


def extract_text(pages: DataFrame, *, html_col: str = "html", keep: Sequence[str] | None = None, weights: Weights = Weights()) -> DataFrame:
    """The ``keep`` columns (all but the html by default) and text."""
    kept = [c for c in ([c for c in pages.columns if c != html_col] if keep is None else keep) if c != "text"]
    rows = pages.select(F.col(html_col).cast("string").alias("html"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    found = rows.mapInArrow(_extract(weights), T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
    return found.select(*[F.col("row").getField(c).alias(c) for c in kept], "text")
