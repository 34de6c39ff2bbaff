"""Main text of web pages from flat text blocks and a trained decision tree.

A page becomes a flat list of text blocks, cut at block-level tags.  A block is
described by its word count and link density, by those of the blocks before and
after it, and by what its enclosing elements say of themselves.  A decision
tree, grown from the small labelled table below, keeps or drops it.

Word counts and link densities alone cannot tell an advert of a dozen words from
a paragraph of one: a tree of them alone judges about nine blocks of ten rightly
(test_main_text.py), so the enclosing elements are features beside them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import bound_batches, table

#: Elements that do not break a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text.
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video textarea select datalist".split())
#: Elements that frame a page rather than tell its story.
FRAME = frozenset("nav header footer aside menu form button dialog".split())
STORY = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that close an open paragraph.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that a paragraph open outside does not reach into.
SCOPES = frozenset("table td th caption button marquee".split())
#: Words in class, id and role that tell of frames.
FRAME_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?s?|nav(?:bar|igation)?|menu|breadcrumbs?|header|masthead|footer|foot|side ?bar|aside|widget|cookies?|consent|notice|alert|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommend(?:ed|ations)?|comments?|replies|respond|discussion|disqus|form|search|toolbar|pagination|pager|copyright|legal|disclaimer|complementary|contentinfo|dialog)(?=$|[\s_-])",
    re.IGNORECASE,
)
STORY_NAMES = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|body|main|text)(?:$|[\s_-])", re.IGNORECASE)

#: A story's own head, as in "entry-header", is no frame.
OWN_HEAD = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-])", re.IGNORECASE)

FEATURES = ("in_frame", "in_story", "page_has_story", "heading", "words", "link_density", "words_before", "links_before", "words_after", "links_after")


class Block:
    __slots__ = ("text", "words", "linked", "frame", "story", "heading")

    def __init__(self, text: str, linked: int, frame: bool, story: bool, heading: bool):
        self.text, self.words = text, len(text.split())
        self.linked, self.frame, self.story, self.heading = min(1.0, linked / max(1, self.words)), frame, story, heading


class _Flattener(HTMLParser):
    """Collects a page's text blocks in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, int, int, int]] = []  # tag, and what it adds to frame, story and hidden
        self.at: dict[str, list[int]] = {}  # where in open each tag stands
        self.blocks_at: list[int] = []  # where those stand that are not inline
        self.scopes_at: list[int] = []
        self.frame = self.story = self.hidden = self.links = self.heads = 0
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.linked, self.frame > 0, self.story > 0, self.heads > 0))
        self.parts.clear()
        self.linked = 0

    def _push(self, tag: str, frame: bool, story: bool, hidden: bool) -> None:
        where = len(self.open)
        self.open.append((tag, int(frame), int(story), int(hidden)))
        self.at.setdefault(tag, []).append(where)
        if tag not in INLINE:
            self.blocks_at.append(where)
        if tag in SCOPES:
            self.scopes_at.append(where)
        self.frame += frame
        self.story += story
        self.hidden += hidden
        self.links += tag == "a"
        self.heads += tag in HEADINGS

    def _pop(self) -> None:
        tag, frame, story, hidden = self.open.pop()
        self.at[tag].pop()
        if tag not in INLINE:
            self.blocks_at.pop()
        if tag in SCOPES:
            self.scopes_at.pop()
        self.frame -= frame
        self.story -= story
        self.hidden -= hidden
        self.links -= tag == "a"
        self.heads -= tag in HEADINGS

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
            if tag in CLOSES_P and (p := self.at.get("p")) and p[-1] > (self.scopes_at or [-1])[-1]:
                self._close("p")
        if tag in VOID:
            return
        said = [v for k, v in attrs if k in ("class", "id", "role") and v]
        told = bool(said) and tag not in ("body", "html") and any(STORY_NAMES.search(v) for v in said)
        framing = [v for v in said if FRAME_NAMES.search(OWN_HEAD.sub(" ", v) if told else v)]
        named = bool(framing) and tag not in ("body", "html", *STORY)
        shut = any(k == "hidden" or k == "style" and v and re.search(r"display\s*:\s*none", v) or k == "aria-hidden" and v == "true" for k, v in attrs)
        # an article's own <header> is dropped as the page's is
        self._push(tag, tag in FRAME or named, tag in STORY or told and not named, tag in HIDDEN or shut)

    def _close(self, tag: str) -> None:
        """The last open tag of that name ends, and all within it; an inline one only where no block was opened since."""
        where = self.at.get(tag)
        if where and (tag not in INLINE or where[-1] > (self.blocks_at or [-1])[-1]):
            at = where[-1]
            while len(self.open) > at:
                self._pop()

    def handle_startendtag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        self._close(tag)

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.split())


def blocks_of(html: str | None) -> list[Block]:
    if not html:
        return []
    page = _Flattener()
    page.feed(html)
    rest = page.rawdata if not page.cdata_elem else ""
    if rest and not page.hidden and not re.match(r"<[!/?a-zA-Z]", rest):  # text after the last tag of a page that breaks off
        page.parts.append(unescape(rest))
    page.flush()
    return page.blocks


def features_of(blocks: list[Block]) -> list[tuple[float, ...]]:
    """FEATURES of each block of a page."""
    has = float(any(b.story for b in blocks))
    edge = Block("", 0, False, False, False)
    around = [edge, *blocks, edge]
    return [(float(b.frame), float(b.story), has, float(b.heading), b.words, b.linked, p.words, p.linked, n.words, n.linked) for p, b, n in zip(around, around[1:], around[2:], strict=False)]


#: Labelled blocks (FEATURES, then 1: main text): a page's frame, its story, and pages that mark neither.
LABELLED = [
    # menus, headers, footers, adverts, notices, forms and comments, marked as such
    (1, 0, 1, 0, 1, 1.0, 0, 0.0, 1, 1.0, 0), (1, 0, 1, 0, 1, 1.0, 1, 1.0, 1, 1.0, 0), (1, 0, 1, 0, 2, 1.0, 1, 1.0, 12, 0.0, 0), (1, 0, 1, 0, 12, 0.0, 1, 1.0, 9, 0.0, 0),
    (1, 0, 1, 0, 60, 0.0, 3, 1.0, 9, 0.0, 0), (1, 0, 1, 0, 7, 0.1, 40, 0.0, 0, 0.0, 0), (1, 0, 1, 1, 3, 0.0, 20, 0.0, 5, 1.0, 0), (1, 1, 1, 0, 25, 0.0, 60, 0.0, 30, 0.0, 0),
    (1, 1, 1, 0, 4, 1.0, 60, 0.0, 80, 0.0, 0), (1, 1, 1, 1, 2, 0.0, 90, 0.0, 15, 0.0, 0), (1, 1, 1, 0, 70, 0.0, 15, 0.0, 40, 0.0, 0), (1, 0, 0, 0, 30, 0.0, 30, 0.0, 30, 0.0, 0),
    (1, 0, 0, 0, 4, 1.0, 3, 1.0, 5, 1.0, 0), (1, 0, 0, 0, 1, 0.0, 60, 0.0, 0, 0.0, 0), (1, 0, 0, 1, 4, 0.0, 70, 0.0, 50, 0.0, 0), (1, 1, 1, 0, 1, 0.0, 1, 0.0, 1, 0.0, 0),
    # stories, marked as such, of paragraphs of any length
    (0, 1, 1, 1, 9, 0.0, 13, 0.0, 40, 0.0, 1), (0, 1, 1, 1, 1, 0.0, 2, 1.0, 60, 0.0, 1), (0, 1, 1, 0, 80, 0.0, 9, 0.0, 45, 0.0, 1), (0, 1, 1, 0, 1, 0.0, 50, 0.0, 1, 0.0, 1),
    (0, 1, 1, 0, 1, 0.0, 1, 0.0, 14, 0.0, 1), (0, 1, 1, 0, 14, 0.1, 1, 0.0, 6, 0.0, 1), (0, 1, 1, 0, 120, 0.3, 70, 0.0, 6, 1.0, 1), (0, 1, 1, 0, 6, 1.0, 120, 0.0, 50, 0.0, 1),
    (0, 1, 1, 0, 3, 0.0, 4, 0.0, 5, 0.1, 1), (0, 1, 1, 0, 30, 0.9, 40, 0.0, 40, 0.0, 1), (0, 1, 1, 1, 5, 1.0, 0, 0.0, 50, 0.0, 1), (0, 1, 1, 0, 2, 0.0, 60, 0.0, 0, 0.0, 1),
    (0, 1, 1, 0, 20, 0.0, 30, 0.0, 6, 1.0, 1), (0, 1, 1, 0, 3, 0.0, 10, 0.0, 5, 1.0, 1), (0, 1, 1, 1, 4, 0.0, 6, 1.0, 5, 1.0, 1), (0, 1, 1, 0, 45, 0.0, 2, 1.0, 9, 0.8, 1),
    (0, 1, 1, 0, 1, 0.0, 9, 1.0, 3, 1.0, 1), (0, 1, 1, 0, 8, 1.0, 7, 1.0, 9, 1.0, 1), (0, 1, 1, 0, 2, 1.0, 40, 0.0, 2, 1.0, 1),
    # what stands beside a marked story without a mark of its own
    (0, 0, 1, 0, 5, 1.0, 4, 1.0, 9, 0.0, 0), (0, 0, 1, 0, 14, 0.0, 50, 0.0, 6, 1.0, 0), (0, 0, 1, 0, 40, 0.0, 1, 0.0, 60, 0.0, 0), (0, 0, 1, 1, 5, 0.0, 9, 1.0, 8, 0.0, 0),
    (0, 0, 1, 0, 1, 0.0, 1, 0.0, 1, 0.0, 0), (0, 0, 1, 0, 90, 0.0, 80, 0.0, 70, 0.0, 0),
    # pages without marks: text dense blocks and what lies between them are the story
    (0, 0, 0, 0, 40, 0.0, 12, 0.0, 50, 0.0, 1), (0, 0, 0, 0, 60, 0.1, 40, 0.0, 40, 0.0, 1), (0, 0, 0, 0, 30, 0.0, 8, 0.0, 4, 0.0, 1), (0, 0, 0, 0, 22, 0.0, 1, 1.0, 30, 0.0, 1),
    (0, 0, 0, 0, 8, 0.0, 40, 0.0, 35, 0.0, 1), (0, 0, 0, 0, 12, 0.0, 30, 0.0, 18, 0.1, 1), (0, 0, 0, 0, 6, 0.0, 50, 0.0, 60, 0.0, 1), (0, 0, 0, 1, 6, 0.0, 3, 1.0, 45, 0.0, 1),
    (0, 0, 0, 1, 4, 0.0, 40, 0.0, 30, 0.0, 1), (0, 0, 0, 1, 8, 0.0, 5, 1.0, 60, 0.0, 1), (0, 0, 0, 0, 90, 0.2, 10, 1.0, 5, 1.0, 1), (0, 0, 0, 0, 12, 0.0, 0, 0.0, 0, 0.0, 1),
    (0, 0, 0, 0, 9, 0.0, 12, 0.0, 11, 0.0, 1), (0, 0, 0, 0, 11, 0.0, 9, 0.0, 0, 0.0, 1), (0, 0, 0, 0, 25, 0.0, 0, 0.0, 0, 0.0, 1),
    (0, 0, 0, 0, 14, 0.0, 0, 0.0, 4, 1.0, 1), (0, 0, 0, 0, 35, 0.0, 20, 0.0, 4, 1.0, 1), (0, 0, 0, 0, 18, 0.0, 30, 0.0, 3, 1.0, 1), (0, 0, 0, 0, 50, 0.0, 1, 1.0, 2, 1.0, 1),
    (0, 0, 0, 0, 3, 1.0, 0, 0.0, 40, 0.0, 0), (0, 0, 0, 0, 4, 1.0, 60, 0.0, 45, 0.0, 0), (0, 0, 0, 0, 2, 1.0, 40, 0.0, 0, 0.0, 0), (0, 0, 0, 0, 5, 0.8, 0, 0.0, 70, 0.0, 0),
    (0, 0, 0, 0, 4, 1.0, 5, 1.0, 3, 1.0, 0), (0, 0, 0, 0, 9, 1.0, 30, 0.0, 10, 1.0, 0), (0, 0, 0, 0, 3, 0.0, 2, 1.0, 3, 1.0, 0), (0, 0, 0, 0, 5, 0.0, 4, 1.0, 2, 1.0, 0),
    (0, 0, 0, 0, 30, 0.8, 10, 1.0, 12, 1.0, 0), (0, 0, 0, 0, 2, 0.5, 60, 0.0, 0, 0.0, 0), (0, 0, 0, 0, 6, 0.9, 50, 0.0, 40, 0.0, 0), (0, 0, 0, 1, 3, 1.0, 4, 1.0, 6, 1.0, 0),
    (0, 0, 0, 1, 3, 0.0, 30, 0.0, 4, 1.0, 0), (0, 0, 0, 0, 15, 0.7, 3, 1.0, 4, 1.0, 0), (0, 0, 0, 0, 4, 0.0, 9, 1.0, 0, 0.0, 0),
    # blocks as they were read off pages: menus, adverts and footers, then articles
    (1, 0, 1, 0, 1, 1, 0, 0, 1, 1, 0), (1, 0, 1, 0, 1, 1, 1, 1, 1, 1, 0), (1, 0, 1, 0, 1, 1, 1, 1, 4, 0, 0), (1, 0, 1, 0, 1, 1, 1, 1, 6, 0, 0), (1, 0, 1, 0, 1, 1, 1, 1, 8, 0, 0),
    (1, 0, 1, 0, 1, 1, 1, 1, 9, 0, 0), (1, 0, 1, 0, 1, 1, 1, 1, 11, 0, 0), (1, 0, 1, 0, 1, 1, 1, 1, 13, 0, 0), (1, 0, 1, 0, 5, 0, 1, 1, 12, 0, 0), (1, 0, 1, 0, 7, 0, 5, 0, 0, 0, 0),
    (1, 0, 1, 0, 8, 0, 1, 0, 0, 0, 0), (1, 0, 1, 0, 8, 0, 1, 1, 2, 0, 0), (1, 0, 1, 0, 8, 0, 1, 1, 8, 0, 0), (1, 0, 1, 0, 8, 0, 1, 1, 10, 0, 0), (1, 0, 1, 0, 8, 0, 5, 0, 0, 0, 0),
    (1, 0, 1, 0, 9, 0, 1, 1, 7, 0, 0), (1, 0, 1, 0, 9, 0, 1, 1, 11, 0, 0), (1, 0, 1, 0, 9, 0, 8, 0, 0, 0, 0), (1, 0, 1, 0, 9, 0, 9, 0, 0, 0, 0), (1, 0, 1, 0, 9, 0, 58, 0, 0, 0, 0),
    (1, 0, 1, 0, 10, 0, 1, 1, 8, 0, 0), (1, 0, 1, 0, 11, 0, 1, 0, 0, 0, 0), (1, 0, 1, 0, 11, 0, 1, 1, 11, 0, 0), (1, 0, 1, 0, 11, 0, 5, 0, 0, 0, 0), (1, 0, 1, 0, 11, 0, 9, 0, 0, 0, 0),
    (1, 0, 1, 0, 12, 0, 1, 1, 7, 0, 0), (1, 0, 1, 0, 12, 0, 1, 1, 9, 0, 0), (1, 0, 1, 0, 12, 0, 4, 0, 0, 0, 0), (1, 0, 1, 0, 12, 0, 11, 0, 0, 0, 0), (1, 0, 1, 0, 12, 0, 83, 0, 0, 0, 0),
    (1, 0, 1, 0, 13, 0, 1, 1, 4, 0, 0), (1, 0, 1, 0, 13, 0, 1, 1, 10, 0, 0), (1, 0, 1, 0, 13, 0, 6, 0, 0, 0, 0), (1, 0, 1, 0, 13, 0, 9, 0, 0, 0, 0), (1, 0, 1, 0, 13, 0, 10, 0, 0, 0, 0),
    (1, 0, 1, 0, 13, 0, 95, 0, 0, 0, 0), (1, 0, 1, 0, 14, 0, 150, 0, 0, 0, 0), (1, 0, 1, 0, 15, 0, 132, 0, 0, 0, 0),
    (0, 1, 1, 0, 2, 0, 2, 0, 2, 0, 1), (0, 1, 1, 0, 2, 0, 14, 0, 29, 0, 1), (0, 1, 1, 0, 2, 0, 15, 0, 51, 0, 1), (0, 1, 1, 0, 5, 0, 31, 0, 9, 0, 1), (0, 1, 1, 1, 6, 0, 8, 0, 6, 0, 1),
    (0, 1, 1, 1, 8, 0, 8, 0, 8, 0, 1), (0, 1, 1, 1, 9, 0, 6, 0, 9, 0, 1), (0, 1, 1, 0, 9, 0, 9, 0, 114, 0, 1), (0, 1, 1, 1, 10, 0, 8, 0, 85, 0, 1), (0, 1, 1, 0, 10, 0, 10, 0, 19, 0, 1),
    (0, 1, 1, 0, 10, 0, 36, 0, 15, 0, 1), (0, 1, 1, 1, 11, 0, 4, 0, 52, 0, 1), (0, 1, 1, 0, 12, 0, 3, 0, 14, 0, 1), (0, 1, 1, 1, 12, 0, 5, 0, 62, 0, 1), (0, 1, 1, 1, 12, 0, 10, 0, 33, 0, 1),
    (0, 1, 1, 0, 18, 0, 29, 0, 3, 0, 1), (0, 1, 1, 0, 23, 0, 12, 0, 2, 0, 1), (0, 1, 1, 0, 23, 0, 22, 0, 12, 0, 1), (0, 1, 1, 0, 26, 0, 88, 0, 124, 0, 1), (0, 1, 1, 0, 27, 0, 31, 0, 42, 0, 1),
    (0, 1, 1, 0, 29, 0, 47, 0, 46, 0, 1), (0, 1, 1, 0, 30, 0, 26, 0, 79, 0, 1), (0, 1, 1, 0, 33, 0, 34, 0, 11, 0, 1), (0, 1, 1, 0, 34, 0, 45, 0, 6, 0, 1), (0, 1, 1, 0, 39, 0, 45, 0, 6, 0, 1),
    (0, 1, 1, 0, 42, 0, 155, 0, 1, 0, 1), (0, 1, 1, 0, 50, 0, 3, 0, 28, 0, 1), (0, 1, 1, 0, 52, 0, 31, 0, 152, 0, 1), (0, 1, 1, 0, 53, 0, 9, 0, 51, 0, 1), (0, 1, 1, 0, 58, 0, 2, 0, 20, 0, 1),
    (0, 1, 1, 0, 64, 0, 11, 0, 3, 0, 1), (0, 1, 1, 0, 67, 0, 9, 0, 90, 0, 1), (0, 1, 1, 0, 67, 0, 12, 0, 32, 0, 1), (0, 1, 1, 0, 74, 0, 5, 0, 17, 0, 1), (0, 1, 1, 0, 80, 0, 19, 0, 6, 0, 1),
    (0, 1, 1, 0, 109, 0, 24, 0, 43, 0, 1), (0, 1, 1, 0, 112, 0, 16, 0, 68, 0, 1), (0, 1, 1, 0, 139, 0, 9, 0, 15, 0, 1), (0, 1, 1, 0, 149, 0, 29, 0, 39, 0, 1), (0, 1, 1, 0, 160, 0, 31, 0, 4, 0, 1),
]


def grow(rows: list[tuple[float, ...]], depth: int = 8):
    """A binary tree by Gini impurity: (feature, threshold, low, high) or a leaf 0 / 1.  Ties go to the first feature and threshold."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))

    def impurity(part):
        k = sum(r[-1] for r in part)
        return 2 * k * (len(part) - k) / len(part)

    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            low, high = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            left = impurity(low) + impurity(high)
            if best is None or left < best[0] - 1e-12:
                best = (left, f, cut, low, high)
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, cut, low, high = best
    return f, cut, grow(low, depth - 1), grow(high, depth - 1)


@lru_cache(maxsize=1)
def tree():
    return grow(LABELLED)


def is_main(x: tuple[float, ...]) -> bool:
    node = tree()
    while isinstance(node, tuple):
        f, cut, low, high = node
        node = low if x[f] <= cut else high
    return bool(node)


def extract(html: str | None) -> str:
    """The main text: kept blocks in page order, one space between; empty for a null or textless page."""
    blocks = blocks_of(html)
    return " ".join(b.text for b, x in zip(blocks, features_of(blocks), strict=True) if is_main(x))


#: Pages of a returned batch.
BATCH = 256


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages' other columns but `text` and `n_chars`, and the main text with its code points.

    Each row by itself: repeated rows stay, an empty table gives no rows, a null
    or empty html gives the empty text.
    """
    bound_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(html_col).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                texts = [extract(h) for h in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "text string", "n_chars long"])
    return rows.mapInArrow(run, schema)


def op2_main_text(spark, sf_dir: str) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; the empty text and 0 for a null, empty or textless html."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
