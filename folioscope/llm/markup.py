"""Blocks of text in a web page, each with its path of block elements. Tag soup is read as browsers do where it matters here."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

# Elements of HTML by what they do to text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math nobr q rb rp rt rtc ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
RAW = set("iframe noembed noframes script style textarea title xmp".split())
NOT_TEXT = set("aside audio button canvas datalist dialog footer form frameset head iframe menu nav noembed noframes noscript object option script select style svg template textarea title video xmp".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# A new element of the first kind ends an open one of the second, unless one of the third is open inside.
IMPLIED_ENDS = {
    **dict.fromkeys(["li"], ({"li"}, {"ul", "ol", "menu"})),
    **dict.fromkeys(["dt", "dd"], ({"dt", "dd"}, {"dl"})),
    **dict.fromkeys(["tr"], ({"tr", "td", "th"}, {"table"})),
    **dict.fromkeys(["td", "th"], ({"td", "th"}, {"tr", "table"})),
    **dict.fromkeys(["tbody", "thead", "tfoot"], ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})),
    **dict.fromkeys(["option", "optgroup"], ({"option"}, {"select"})),
    **dict.fromkeys(["article", "main"], ({"nav", "header", "footer"}, {"article", "main", "aside"})),
    **dict.fromkeys(["body"], ({"head"}, set())),
}
PARAGRAPH_ENDS_IN = set("td th li dd dt caption button object table".split())

# Words in class names, ids and roles that mark what is around an article.
AROUND_WORDS = set(
    "ad ads adsbygoogle advert adverts advertising advertisement alert alertdialog banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies copyright disclaimer disqus dialog feedback follow footer form gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification outbrain pager pagination paywall popup promo promotion promoted recommended related replies reply "
    "respond rss search share sharing sidebar signup sitemap skip social sponsor sponsored subscribe subscription taboola toolbar topbar trending widget".split()
)
ARTICLE_NAMES = set("article article-body article-content body content entry entry-content main main-content page-content post post-body post-content story story-body text".split())
NEGATED = ("has-", "with-", "no-", "not-", "is-")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)|[^>]*)(?:>|\Z)", re.S
)
RAW_ENDS = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


@dataclass(eq=False)
class Element:
    tag: str
    parent: Element | None
    around: bool = False  # it and all within belong to what is around an article
    header: bool = False  # within a header, where only headings are text
    within: bool = False  # within an article or main element
    path: int = 0  # elements of equal labels from the root down have one number
    depth: int = 0
    held: int = 0  # for counts of what lies within
    inside: bool = False

    def chain(self):
        at = self
        while at is not None:
            yield at
            at = at.parent


@dataclass(eq=False)
class Block:
    element: Element
    text: str
    linked: int  # characters within links


def attributes(rest: str) -> dict[str, str]:
    return {name.lower(): unescape(a or b or c) for name, a, b, c in ATTRIBUTE.findall(rest)}


def marks_around(tag: str, known: dict[str, str]) -> bool:
    """Whether class names, id or role say that the element is no part of an article."""
    if "hidden" in known or known.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", known.get("style", "")):
        return True
    if tag in ("html", "body", "main"):
        return False
    names = known.get("class", "").split() + [v for v in (known.get("id"), known.get("role")) if v]
    if any(n.lower() in ARTICLE_NAMES for n in names):
        return False
    return any(part.lower() in AROUND_WORDS for n in names if not n.lower().startswith(NEGATED) for part in PARTS.findall(n))


@lru_cache(maxsize=4096)
def described(tag: str, rest: str) -> tuple[str, bool]:
    """Label of an element for its path, and whether it is around an article; the same tags come again and again."""
    known = attributes(rest)
    names = known.get("class", "").split()
    return f"{tag}.{names[0]}" if names else tag, tag in NOT_TEXT or marks_around(tag, known)


class Page:
    """Reads a page into blocks: text between the borders of block elements, white space as one space, empty ones left out."""

    def __init__(self, html: str) -> None:
        self.blocks: list[Block] = []
        self.open = Element("", None)
        self.elements = [self.open]  # parents before what they hold
        self.paths: dict[tuple[int, str], int] = {}
        self.open_tags: Counter = Counter()
        self.pieces: list[str] = []
        self.link_depth = 0
        self.linked = 0
        self._read(html)

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            token = TOKEN.search(html, at)
            if token is None:
                self._text(html[at:])
                break
            if token.start() > at:
                self._text(html[at : token.start()])
            at = token.end()
            name = token["name"]
            if name is None:
                continue
            tag = name.lower()
            if html[token.start() + 1] == "/":
                self._close(tag)
            elif tag in RAW:
                self._cut(tag)
                found = RAW_ENDS[tag].search(html, at)
                at = end if found is None else html.find(">", found.start()) + 1 or end
            else:
                self._start(tag, token["rest"])
        self._cut("")

    def _text(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.pieces.append(text)
        if self.link_depth:
            self.linked += len("".join(text.split()))

    def _cut(self, tag: str) -> None:
        """Ends the block at the border of a block element."""
        if tag in INLINE:
            return
        text = " ".join("".join(self.pieces).split())
        if text:
            self.blocks.append(Block(self.open, text, self.linked))
        self.pieces, self.linked = [], 0

    def _start(self, tag: str, rest: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.link_depth = 1  # links do not nest
            elif tag == "br":
                self.pieces.append(" ")
            return
        self._cut(tag)
        self.link_depth = 0
        if tag in VOID:
            return
        if tag not in ("html", "body"):
            self._end_open({"p"}, PARAGRAPH_ENDS_IN)
        if tag in HEADINGS:
            self._end_open(HEADINGS, {self.open.tag} - HEADINGS)
        if tag in IMPLIED_ENDS:
            ends, inside = IMPLIED_ENDS[tag]
            while self._end_open(ends, inside):
                pass
        up = self.open
        label, around = described(tag, rest)
        header, around = up.header or tag == "header", up.around or around
        if tag in ("article", "main") and up.around:
            for e in up.chain():  # a form around the whole page is no form of the article
                if e.tag == "form" and not (e.parent and e.parent.around):
                    around = False
        path = self.paths.setdefault((up.path, label), len(self.paths) + 1)
        self.open = Element(tag, up, around, header, up.within or tag in ("article", "main"), path, up.depth + 1)
        self.elements.append(self.open)
        self.open_tags[tag] += 1

    def _end_open(self, ends: set[str], inside: set[str]) -> bool:
        if not any(map(self.open_tags.__getitem__, ends)):
            return False
        for e in self.open.chain():
            if e.tag in ends:
                self._leave(e)
                return True
            if e.tag in inside:
                return False
        return False

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.link_depth = 0
            return
        self._cut(tag)
        self.link_depth = 0
        if not self.open_tags[tag]:
            return
        for e in self.open.chain():
            if e.tag == tag:
                self._leave(e)
                return
            if e.tag == "table" and tag in ("p", "div", "span"):
                return  # an end tag in a cell does not end what holds the table

    def _leave(self, element: Element) -> None:
        """Closes the element and what is open in it."""
        up = element.parent
        while self.open is not up:
            self.open_tags[self.open.tag] -= 1
            self.open = self.open.parent
