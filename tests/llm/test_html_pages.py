"""Main text of pages, each written out by hand, and the work on hostile nesting."""

import random
import time

import pytest

from lintlake.llm import html_extract

ONE = "The first paragraph has several words, some commas, and an end that comes late enough to count."
TWO = "A second paragraph follows, which is as plain as the first, and nearly as long as it."
BODY = f"<p>{ONE}</p><p>{TWO}</p>"
TEXT = f"{ONE}\n{TWO}"

PAGES = {
    "article and chrome": (f"<body><nav><a href=/>Home</a></nav><header>Site</header><article><h1>Title</h1>{BODY}</article><footer>Imprint, 2024</footer></body>", f"Title\n{TEXT}"),
    "no html at all": (f"{ONE}", ONE),
    "paragraphs in the body": (f"<html><body>{BODY}</body></html>", TEXT),
    "deep wrappers": ("<div>" * 30 + BODY + "</div>" * 30, TEXT),
    "unclosed paragraphs": (f"<article><p>{ONE}<p>{TWO}</article><aside><p>Aside, aside</aside>", TEXT),
    "line breaks are blanks": ("<article><p>one,<br>two<br/>three</p></article>", "one, two three"),
    "inline markup joins": ("<article><p>un<b>break</b>able, <i>but</i> <em>apart</em></p></article>", "unbreakable, but apart"),
    "references": ("<article><p>&lt;a&gt; &amp;amp; &eacute;&#233;&#xe9; &nbsp; x&copy; &unknown; 5 &lt 6</p></article>", "<a> &amp; ééé x© &unknown; 5 < 6"),
    "white space": ("<article><p>\n a\t  b \r\n c </p>\n\n<p> d</p></article>", "a b c\nd"),
    "lists and quotes": (f"<article>{BODY}<ul><li>one<li>two</ul><ol><li>three</li></ol><blockquote>said, so</blockquote><pre>x  =  1</pre></article>", f"{TEXT}\none\ntwo\nthree\nsaid, so\nx = 1"),
    "table": (f"<article>{BODY}<table><caption>cap<tr><th>a<th>b<tr><td>1<td>2</table></article>", f"{TEXT}\ncap\na\nb\n1\n2"),
    "definition list": (f"<article>{BODY}<dl><dt>term<dd>meaning<dt>other<dd>sense</dl></article>", f"{TEXT}\nterm\nmeaning\nother\nsense"),
    "figure": (f"<article>{BODY}<figure><img src=x alt=no><figcaption>A caption</figcaption></figure></article>", f"{TEXT}\nA caption"),
    "scripts and styles": (f"<article><script>var a = '<p>no, no</p>';</script>{BODY}<style>p{{}}</style><noscript>no</noscript></article>", TEXT),
    "comments of markup": (f"<article><!-- <p>no, no, no</p> -->{BODY}<!-- open", TEXT),
    "adverts inside": (f"<article><p>{ONE}</p><div class=ad>Buy, now</div><div class='sponsored-box'>More, more</div><p>{TWO}</p></article>", TEXT),
    "forms": (f"<article>{BODY}<form><label>Name</label><input><button>Go</button></form></article>", TEXT),
    "reader comments": (f"<main><article>{BODY}</article><section id=comments><article class=comment><p>Nice, great, thanks, all</p></article></section></main>", TEXT),
    "notices": (f"<div class=cookie-banner><p>We use cookies, many, many of them, for your comfort.</p></div><div id=page>{BODY}</div>", TEXT),
    "sidebar": (f"<div class=row><div class=sidebar><p>Side, story, one, two, three, four, five, six</p></div><div class=text>{BODY}</div></div>", TEXT),
    "link lists outside": (f"<div>{BODY}</div><ul><li><a href=1>One more story</a><li><a href=2>And another one</a></ul>", TEXT),
    "hidden parts": (f"<article>{BODY}<p hidden>not, seen</p><div style='display: none'>nor, this</div><p aria-hidden=true>nor that</p></article>", TEXT),
    "quoted signs in attributes": (f"<article><p title='a > b' data-x=\"<p>\">{ONE}</p><p>{TWO}</p></article>", TEXT),
    "signs that are no tags": ("<article><p>1 < 2, 3 > 2, a <- b, x<y</p></article>", None),
    "upper case": (f"<BODY><ARTICLE><P>{ONE}<P>{TWO}</ARTICLE><FOOTER>foot</FOOTER></BODY>", TEXT),
    "crossed tags": (f"<article><p><b>{ONE}</p><p>{TWO}</b></p></article>", TEXT),
    "two articles' sections": (f"<article><section><p>{ONE}</p></section><section><h2>Part</h2><p>{TWO}</p></section></article>", f"{ONE}\nPart\n{TWO}"),
    "address and details": (f"<article>{BODY}<details><summary>More</summary><p>inside, it</p></details><address>Street 1</address></article>", f"{TEXT}\nMore\ninside, it\nStreet 1"),
    "only chrome": ("<nav><a href=/>Home</a></nav><footer>foot</footer>", ""),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, want = PAGES[name]
    got = html_extract.main_text(html)
    assert got == want if want is not None else got.startswith("1 < 2, 3 > 2, a <- b, x")


class Plain:
    """The tree as a walk over all open elements gives it."""

    def __init__(self):
        self.tags, self.parents, self.stack = ["#root"], [-1], [0]

    def imply(self, ends, scope):
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[i]]
            if tag in ends:
                del self.stack[i:]
                if len(ends) > 1:
                    self.imply(ends, scope)
                return
            if tag in scope:
                return

    def start(self, tag):
        kind = tag if tag in html_extract.CLOSES else "p" if tag in html_extract.BLOCK else None
        if kind:
            self.imply(*html_extract.IMPLIED[kind])
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.stack.append(len(self.tags) - 1)

    def end(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.tags[self.stack[i]] == tag:
                del self.stack[i:]
                return
            if self.tags[self.stack[i]] == "table" and tag not in html_extract.BLOCK:
                return


def test_tree_against_a_walk():
    rng = random.Random(4)
    tags = ["p", "div", "span", "b", "ul", "li", "table", "tr", "td", "th", "button", "dl", "dt", "dd", "a", "article", "section", "option", "h2", "tbody"]
    for _ in range(600):
        plain, page = Plain(), []
        for _ in range(rng.randrange(50)):
            tag, closing = rng.choice(tags), rng.random() < 0.45
            page.append(f"</{tag}>" if closing else f"<{tag}>")
            (plain.end if closing else plain.start)(tag)
        elements, _ = html_extract.parse("".join(page))
        assert [(e.tag, e.parent) for e in elements] == list(zip(plain.tags, plain.parents, strict=True))


@pytest.mark.parametrize("piece", ["<div>text, a ", "<ul><li>", "<span>", "<table><tr><td>x", "<p><button>", "<a href=x>y "])
def test_deep_pages_take_linear_time(piece):
    """A hundred thousand open elements, with stray end tags and blocks below them."""
    page = piece * 100_000 + "</b>" * 50_000 + "<div></div>" * 50_000
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 20
