"""Main text of web pages by tree scoring.

A tolerant tokenizer builds a tree of elements and blocks of text. Each paragraph gives points for its length and commas
to its parent, half of them to the parent's parent and less to those above, sixteen in all; an element's score is discounted by the
share of its text that is in links. The best container is kept with those of its siblings that also hold content, and
from it all blocks outside menus, adverts, forms, comments and the like, in page order. A mark that is one word of a
longer name (``side-effects``) drops nothing within the container, and lists of links stay within an article.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_arrow

TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>)", re.S)
#: The same for a tag with ``>`` inside a quoted attribute.
QUOTED = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: Elements whose content is no markup: it ends at their own end tag only.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that never hold article text.
JUNK = RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "object", "svg", "canvas", "template", "menu", "dialog", "audio", "video", "map", "label", "fieldset", "applet"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "head"} | RAW
#: Blocks of text: their parent is the container that gets the points.
LEAF = {"p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "td", "th", "figcaption", "caption", "summary", "address"}
#: Words in class, id or role that mark a part as no article text.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "sponsors", "promo", "promoted", "promotion", "banner", "sidebar", "side", "widget", "widgets", "comment", "comments", "disqus", "reply", "replies", "respond", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "toast", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "header", "masthead", "topbar", "toolbar", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "search", "skip", "contentinfo", "complementary", "advertorial", "outbrain", "taboola", "paywall", "toc", "tags", "legal", "copyright", "disclaimer"}
#: Words beside a mark in the same name that make it a state of what holds it: ``has-sidebar``, ``comments-open``.
BEFORE, AFTER = {"has", "with", "without", "no", "not", "non"}, {"open", "closed", "enabled", "disabled"}
#: The marks that count for an ``article`` too: comments and adverts are often set as one.
ARTICLE_MARKS = {"comment", "reply", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "promoted"}
#: Words of layout: a name of marks and these only is a mark (``comment-list``, ``sidebar-left``); any other word makes it a slug.
LAYOUT = {"area", "bar", "block", "bottom", "box", "btn", "button", "buttons", "col", "column", "container", "content", "div", "entry", "form", "group", "holder", "icon", "icons", "inner", "item", "items", "layer", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "posts", "primary", "right", "secondary", "section", "site", "slot", "top", "unit", "wrap", "wrapper"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
#: Elements that an implied end tag does not reach across.
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "p": {"table", "td", "th", "caption", "button", "object"}}
TABLE = {"table"}
TOP = {"html", "body", "main"}
#: For each kind of implied end tag the elements it ends, and those it does not reach across.
IMPLIED = {tag: (ends, SCOPE.get(tag, TABLE)) for tag, ends in CLOSES.items()} | {"p": ({"p"}, SCOPE["p"] | {"div", "article", "section", "main", "body"})}
KINDS = {kind: i for i, kind in enumerate(IMPLIED)}
#: The kinds for which a tag is of interest.
OF_INTEREST = {tag: [KINDS[k] for k, (ends, scope) in IMPLIED.items() if tag in ends | scope] for tag in set().union(*(ends | scope for ends, scope in IMPLIED.values()))}
#: Ancestors that get points of a paragraph.
LEVELS = 16


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    junk: bool
    link: bool
    slug: bool = False  # in a part with a mark in a longer name: article text only within the article
    article: bool = False  # in an ``article`` or ``main``, or one itself
    points: float = 0.0
    chars: int = 0
    linked: int = 0


@dataclass(slots=True)
class Block:
    owner: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0


def _marked(attributes: str, tag: str) -> int:
    """2 if the names mark an element as no article text, 1 if a mark is one word of a longer slug, else 0.

    The id of a heading or paragraph is an anchor and marks nothing; of a heading's other names only adverts and
    comments count.
    """
    if not attributes or attributes.isspace():
        return 0
    if HIDDEN.search(attributes):
        return 2
    found, marks = 0, ARTICLE_MARKS if tag == "article" or tag in HEADINGS else MARKS
    for m in NAMES.finditer(attributes):
        if m[1].lower() == "id" and (tag == "p" or tag in HEADINGS):
            continue
        for name in (m[2] or m[3] or m[4] or "").split():
            words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
            for i, word in enumerate(words):
                if word in marks and not BEFORE.intersection(words[:i]) and not AFTER.intersection(words[i + 1 :]):
                    if all(w in MARKS or w in LAYOUT or w[0].isdigit() for w in words):
                        return 2
                    found = 1
    return found


class _Open:
    """The open elements, with what finds an end tag's or an implied end's element without a walk: how many of a tag are
    open in all and since the innermost table, and for each kind of implied end the innermost element of interest."""

    def __init__(self, elements: list[Element]) -> None:
        self.elements, self.stack, self.owner = elements, [0], [0]
        self.total: dict[str, int] = {}
        self.scopes: list[dict[str, int]] = [{}]
        self.nearest: list[list[int]] = [[0] * len(KINDS)]

    def push(self, index: int, tag: str) -> None:
        place = len(self.stack)
        self.stack.append(index)
        self.owner.append(index if tag in BLOCK else self.owner[-1])
        self.total[tag] = self.total.get(tag, 0) + 1
        self.scopes[-1][tag] = self.scopes[-1].get(tag, 0) + 1
        if tag in TABLE:
            self.scopes.append({})
        near = self.nearest[-1]
        if tag in OF_INTEREST:
            near = near.copy()
            for k in OF_INTEREST[tag]:
                near[k] = place
        self.nearest.append(near)

    def cut(self, place: int) -> None:
        """Close everything from a place in the stack on."""
        while len(self.stack) > place:
            tag = self.elements[self.stack.pop()].tag
            self.owner.pop()
            self.nearest.pop()
            if tag in TABLE:
                self.scopes.pop()
            self.total[tag] -= 1
            self.scopes[-1][tag] -= 1

    def close(self, tag: str) -> None:
        """An end tag: that of a block closes the innermost one, any other only within the innermost table."""
        if (self.total if tag in BLOCK else self.scopes[-1]).get(tag, 0):
            place = len(self.stack) - 1
            while self.elements[self.stack[place]].tag != tag:
                place -= 1
            self.cut(place)

    def imply(self, kind: str) -> None:
        """Close the innermost elements that a start tag ends, and all in them, unless one of its scope is between."""
        ends = IMPLIED[kind][0]
        while True:
            place = self.nearest[-1][KINDS[kind]]
            if not place or self.elements[self.stack[place]].tag not in ends:
                return
            self.cut(place)
            if len(ends) == 1:
                return


def parse(html: str) -> tuple[list[Element], list[Block]]:
    """Elements (0 is the root) and blocks of text in page order; unclosed, stray and crossed tags are tolerated.

    One pass; the work is that of the page's length, however deep it nests.
    """
    elements = [Element("#root", -1, False, False)]
    blocks: list[Block] = []
    open_ = _Open(elements)
    stack = open_.stack
    block: Block | None = None
    at, n, balanced, last = 0, len(html), True, html.rfind(">")

    def text(piece: str) -> None:
        nonlocal block
        own = elements[stack[-1]]
        if own.junk or not piece:
            return
        if block is None:
            if piece.isspace():
                return
            block = Block(open_.owner[-1])
            blocks.append(block)
        if "&" in piece:
            piece = entities.unescape(piece)
        block.pieces.append(piece)
        if own.link:
            block.linked += len(piece.strip())

    while at < n:
        start = html.find("<", at)
        if start < 0 or start > last:
            text(html[at:].partition("<!--")[0])  # a comment that is not closed goes to the end
            break
        m = TAG.match(html, start)
        if m is None:  # a sign, not a tag
            text(html[at : start + 1])
            at = start + 1
            continue
        text(html[at:start])
        if balanced and m[3] and (m[3].count('"') % 2 or m[3].count("'") % 2):
            if (whole := QUOTED.match(html, start)) is None:
                balanced = False  # a quote stays open to the end; from here on tags end at the next sign
            else:
                m = whole
        at = m.end()
        if m[2] is None:
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCK:
            block = None
        if closing:
            open_.close(tag)
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag in CLOSES:
            open_.imply(tag)
        elif tag in BLOCK:
            open_.imply("p")
        up = elements[stack[-1]]
        mark = 0 if tag in TOP or up.junk else _marked(attributes, tag)
        junk = up.junk or tag in JUNK or mark == 2
        slug = tag != "main" and (up.slug or (mark == 1 and not up.article))
        elements.append(Element(tag, stack[-1], junk, up.link or tag == "a", slug, up.article or tag in ("article", "main")))
        if not attributes.endswith("/") or tag in BLOCK or tag == "a":
            open_.push(len(elements) - 1, tag)
    return elements, blocks


def _score(elements: list[Element], texts: list[tuple[int, str, int]]) -> np.ndarray:
    """Points from paragraphs, times the share of text that is not in links; negative for what can be no container.

    A paragraph gives its points to the innermost container, half of them to the next and a third of a share to those
    above, over ``LEVELS`` containers. Lengths are summed from the leaves up: children come after their parents.
    """
    above = [0] * len(elements)  # the innermost container above each element
    for i, e in enumerate(elements[1:], 1):
        above[i] = e.parent if elements[e.parent].tag not in LEAF else above[e.parent]
    for owner, text, linked in texts:
        if elements[owner].slug:
            continue
        elements[owner].chars += len(text)
        elements[owner].linked += linked
        up = owner if elements[owner].tag not in LEAF else above[owner]
        points = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3.0)
        for level in range(LEVELS):
            elements[up].points += points / (1, 2)[level] if level < 2 else points / (3 * level)
            if not up:
                break
            up = above[up]
    for e in reversed(elements[1:]):
        up = elements[e.parent]
        up.chars += e.chars
        up.linked += e.linked
    bonus = {"article": 25.0, "main": 20.0, "div": 5.0, "section": 3.0, "ul": -3.0, "ol": -3.0, "table": -3.0, "html": -10.0, "body": -5.0, "#root": -20.0}
    out = np.full(len(elements), -1e9)
    for i, e in enumerate(elements):
        if e.points and not e.junk and not e.slug and e.tag not in LEAF:
            out[i] = (e.points + bonus.get(e.tag, 0.0)) * (1 - e.linked / max(1, e.chars))
    return out


def main_text(html: str | None) -> str:
    """The blocks of the main text, joined by line ends; empty if there is none."""
    elements, blocks = parse(html or "")
    texts = [(b.owner, t, min(b.linked, len(t))) for b in blocks if (t := " ".join("".join(b.pieces).split()))]
    if not texts:
        return ""
    if all(elements[owner].slug for owner, _, _ in texts):  # a slug around the whole page tells nothing
        for e in elements:
            e.slug = False
    scores = _score(elements, texts)
    best = int(np.argmax(scores))
    i = best
    while i > 0:  # the whole article if the best container is a part of one
        if elements[i].tag in ("article", "main"):
            best = i
            if elements[i].tag == "article":
                break
        i = elements[i].parent
    kept = {best}
    if elements[best].tag not in ("main", "#root"):
        least = max(10.0, 0.2 * scores[best])
        for k, e in enumerate(elements):
            if e.parent == elements[best].parent and not e.junk and not e.slug and k != best:
                share = e.linked / max(1, e.chars)
                if scores[k] >= least or (e.tag in LEAF and e.chars > 80 and share < 0.25 and elements[best].tag != "article"):
                    kept.add(k)
    inside = [False] * len(elements)
    menu = [False] * len(elements)
    for k, e in enumerate(elements):
        inside[k] = k in kept or (e.parent >= 0 and inside[e.parent])
        menu[k] = (e.parent >= 0 and menu[e.parent]) or (e.tag in ("ul", "ol", "dl") and not e.article and e.chars > 0 and e.linked > 0.6 * e.chars)
    return "\n".join(t for owner, t, _ in texts if inside[owner] and not menu[owner])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``; text is empty if there is none (null html, no blocks).

    Null ids and urls and repeated rows stay as they are; extra columns are dropped.
    """

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return one

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return with_arrow(source, "page_id long, url string, text string, n_chars long", make, "html")
