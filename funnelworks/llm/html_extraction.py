"""Main text of web pages by tag-path ratios.

A page is cut into text blocks, each with its root-to-leaf path of block tags. Per path the
text outside links and the punctuation are averaged over its blocks; the two ratios are
smoothed over the blocks in page order and fused by multiplication. Blocks above a threshold
whose path alone, before smoothing, scores high enough too are content. The deepest element
that holds all of them, or the article or main element around it, is the article. Its other
blocks stay if they are not mostly links and lie between two blocks of content, or in running
text (paragraphs, headings, lists, tables that are in no other element), or if an article or
main element says that all is the article. So a list of links, an advert or a footer in an
element of its own goes by its path's score, whatever its class.

Elements that hold no article text by their tag or role (menus, headers, footers, sidebars,
forms, scripts, styles) are left out. Elements that say so by a class or id word alone
(notices, adverts, reader comments) are left out where they hold a small share of the page's
text outside links and no element that says it is the article, and only where enough text
remains. Up to half of the text, the name lowers the score of their blocks, which go if none
is content; beyond that, the path scores alone decide.

Defined cases: NULL or empty html, and pages without text, give an empty text; unclosed and
stray tags are tolerated (a head ends at what cannot be in it, an unclosed element that is left
out where the body or an element that says it is the article begins); a page of any length and
depth is read whole, in time linear in its length; an empty table gives no rows; extra columns
of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from math import exp, log1p, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.llm.common import map_rows

# A tag with its attributes, a comment, or a declaration; text is what lies between.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
NAME_WORD = re.compile(r"[a-z]+|\d+")
PUNCTUATION = ".,;:!?…。，、؛؟"

RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Tags that run inside a block of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
LEFT_OUT = frozenset(
    "head nav header footer aside form button select option input script style noscript template svg math canvas iframe "
    "object embed textarea dialog menu title noframes noembed audio video map datalist".split()
)
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toc toolbar topbar "
    "header masthead banner footer foot colophon copyright sidebar sidebars aside widget widgets rail related recommended recommendations "
    "comment comments commentlist disqus reply replies respond responses discussion "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay lightbox paywall newsletter subscribe "
    "subscription signup login share sharing social form search".split()
)
# In one name with such a word, a word tells a state of the page: has-sidebar, comments-open.
STATE_WORDS = frozenset("has have no not with without is open opened closed enabled disabled".split())
MAIN_WORDS = frozenset("article main content post entry story".split())
# What may stand in a head; anything else ends it.
HEAD_TAGS = frozenset("head html base basefont bgsound link meta title style script noscript template noframes".split())
# Tags whose opening ends an open paragraph, and what ends an open item of the same kind.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl div article section body main select td th".split())

# Shares of a page's text outside links: up to which a class or id word alone leaves an element
# out, up to which it lowers its blocks' scores, and which must remain.
SMALL_SHARE = 0.3
HALF = 0.5
LEAST_REST = 0.25
# Elements that are one block of an article, not the article.
# Elements of running text.
FLOW = frozenset(
    "p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption".split()
)
LONE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre blockquote".split())
SMOOTHING = 1.0
THRESHOLD = 0.5
MAIN_FACTOR = 4.0


class _Element:
    # ``number`` is its place in document order, ``last`` that of the last element in it.
    __slots__ = ("depth", "hidden", "kept", "last", "main", "marked", "named", "number", "parent", "path", "start", "tag")

    def __init__(self, tag: str, parent: _Element | None, path: int, kept: bool, main: bool, named: bool, start: int) -> None:
        self.start = start
        self.depth = parent.depth + 1 if parent else 0
        self.number = self.last = 0
        # the outermost element around it that is left out
        self.hidden: _Element | None = None if kept else parent.hidden or self
        self.tag, self.parent, self.path, self.kept, self.main, self.named = tag, parent, path, kept, main, named
        self.marked = tag in ("article", "main")


class _Block:
    """``parts`` holds (text, whether in a link, innermost element with inline ones that are named)."""

    __slots__ = ("element", "linked", "lowered", "parts", "text")

    def __init__(self, element: _Element) -> None:
        self.element, self.parts, self.linked, self.text = element, [], 0, ""
        self.lowered = False


def _left_out(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element holds no article text, whether it says it is the article, and whether
    its class or id words (taken together) name it as something else."""
    main = tag in ("article", "main")
    if tag in LEFT_OUT:
        return True, False, False
    if not attributes or attributes == "/":
        return False, main, False
    words: set[str] = set()
    named = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False, False
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True, False, False
        elif name == "role":
            if value in LEFT_OUT_ROLES:
                return True, False, False
            main |= value in ("main", "article")
        elif name in ("class", "id") and tag not in ("body", "html"):
            for one in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", unescape(m[2] or m[3] or m[4] or "")).lower().split():
                own = set(NAME_WORD.findall(one))
                words |= own
                named |= bool(own & LEFT_OUT_WORDS) and not own & STATE_WORDS
    mains = bool(words & MAIN_WORDS)
    return False, main or mains, named and not (main and mains)


def text_blocks(html: str) -> list[_Block]:
    """The blocks of text of a page in order, each in the element that holds it."""
    paths: dict[tuple[int, str], int] = {}

    # Elements that hold one which says it is the article.
    holders: set[_Element] = set()

    made: list[_Element] = []

    def child(tag: str, parent: _Element | None, kept: bool, main: bool, named: bool) -> _Element:
        above = parent.path if parent else -1
        node = _Element(tag, parent, paths.setdefault((above, tag), len(paths)), kept, main, named, pos)
        node.number = len(made)
        made.append(node)
        return node

    pos, end = 0, len(html)
    root = at = child("html", None, True, False, False)
    # A named inline element and where it ends.
    inline: _Element | None = None
    inline_end = 0
    blocks: list[_Block] = []
    block: _Block | None = None
    links = 0
    open_of: dict[str, list[_Element]] = {}
    unclosed: set[int] | None = None

    def add(text: str) -> None:
        nonlocal block
        if block is None:
            if not text.strip():
                return
            block = _Block(at)
            blocks.append(block)
        block.parts.append((text, bool(links), inline or at))

    def close(tag: str) -> None:
        if open_of.get(tag):
            leave(open_of[tag][-1])

    def leave(node: _Element) -> None:
        nonlocal at, block
        while at is not node.parent:
            open_of[at.tag].pop()
            at = at.parent
        block = None

    last = _last(html)
    while m := MARKUP.search(html, pos, last):
        if inline is not None and pos >= inline_end:
            inline = None
        if at.tag == "head" and html[pos : m.start()].strip():
            close("head")
        if m.start() > pos and at.kept:
            add(html[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = 0
            elif tag in INLINE:
                pass
            elif tag == "p" and not open_of.get("p"):
                block = None
            else:
                close(tag)
            continue
        if at.tag == "head" and tag not in HEAD_TAGS:
            close("head")
        if tag == "br":
            if at.kept and block is not None:
                block.parts.append((" ", True, inline or at))
            continue
        if tag == "a":
            links = 1
            continue
        if tag in RAW:
            shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, pos)
            pos = shut.start() if shut else end
            continue
        if tag in INLINE:
            # an inline element that is left out (hidden) still hides its text
            out, _, named = _left_out(tag, m[3]) if at.kept else (False, False, False)
            if not out and not named:
                continue
            if out:
                pos = _end_of(html, tag, pos) or pos
            elif inline is None and (shut := _end_of(html, tag, pos)):
                inline, inline_end = child(tag, at, True, at.main, True), shut
            continue
        if tag in VOID:
            block = None
            continue
        if tag in ENDS_PARAGRAPH and open_of.get("p"):
            close("p")
        if tag in SIBLINGS:
            # the innermost open one, unless a list, table or section lies in between
            sibling = max((open_of[t][-1] for t in SIBLINGS[tag] if open_of.get(t)), key=lambda n: n.depth, default=None)
            if sibling and sibling.depth >= max((open_of[t][-1].depth for t in SCOPES if open_of.get(t)), default=-1):
                leave(sibling)
        if tag in ("html", "body") and at is root:
            kept, main, named = True, False, False
        else:
            out, main, named = _left_out(tag, m[3])
            if not at.kept and not out and (tag == "body" or main and not named):
                # the article does not lie in an element left out that nothing closes
                top = at.hidden
                if unclosed is None:
                    unclosed = _unclosed(html)
                if top.start in unclosed or top.tag == "head":
                    leave(top)
            kept = at.kept and not out
        if m[3].endswith("/") and tag in LEFT_OUT:
            continue
        if main and kept and not named:
            node = at
            while node is not None and node not in holders:
                holders.add(node)
                node = node.parent
        at = child(tag, at, kept, main or at.main, named)
        open_of.setdefault(tag, []).append(at)
        block = None
    if inline is not None and pos >= inline_end:
        inline = None
    if at.tag == "head" and html[pos:].strip():
        close("head")
    if pos < end and at.kept:
        add(html[pos:])
    for node in reversed(made):
        node.last = max(node.last, node.number)
        if node.parent:
            node.parent.last = max(node.parent.last, node.last)
    gone, lowered = _named_apart(blocks, holders)
    for b in blocks:
        own = [(t, linked) for t, linked, holder in b.parts if holder not in gone]
        b.lowered = b.element in lowered
        b.linked = sum(len(t) for t, linked in own if linked and t != " ")
        b.text = " ".join(unescape("".join(t for t, _ in own)).split())
    return [b for b in blocks if b.text]


def _end_of(html: str, tag: str, pos: int) -> int | None:
    """Where an inline element ends that began before ``pos``: behind its own closing tag, not
    that of an element of the same name in it."""
    inside = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(html, pos):
        inside += -1 if m[1] else 1
        if not inside:
            return m.end()
    return None


def _last(html: str) -> int:
    """Where markup ends: beyond the last '>' only an unclosed comment is; text may hold any number of '<'."""
    return len(html) if html.rfind("<!--") > html.rfind("-->") else html.rfind(">") + 1


def _unclosed(html: str) -> set[int]:
    """Ends of the opening tags that no closing tag belongs to."""
    opened: dict[str, list[int]] = {}
    pos, last = 0, _last(html)
    while m := MARKUP.search(html, pos, last):
        pos = m.end()
        tag = (m[2] or "").lower()
        if m[1]:
            if opened.get(tag):
                opened[tag].pop()
        elif tag in RAW:
            shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, pos)
            pos = shut.start() if shut else len(html)
        elif tag:
            opened.setdefault(tag, []).append(pos)
    return {at for ends in opened.values() for at in ends}


def _named_apart(blocks: list[_Block], holders: set[_Element]) -> tuple[set[_Element], set[_Element]]:
    """The elements in those that are left out by their class or id words, and in those lowered."""
    size: dict[_Element, int] = {}
    for b in blocks:
        for text, linked, holder in b.parts:
            size[holder] = size.get(holder, 0) + (0 if linked else len(text.strip()))
    # The innermost named element around each element, itself included; outer ones come first.
    around: dict[_Element, _Element | None] = {}
    for node in size:
        new = []
        while node is not None and node not in around:
            new.append(node)
            node = node.parent
        found = around[node] if node is not None else None
        for n in reversed(new):
            found = around[n] = n if n.named else found
    named = [n for n, own in around.items() if n is own]
    outer = {n: around[n.parent] if n.parent else None for n in named}
    total, held = sum(size.values()), dict.fromkeys([None, *named], 0)
    for node, n in size.items():
        held[around[node]] += n
    for n in reversed(named):
        if outer[n] is not None:
            held[outer[n]] += held[n]

    def within(least: float, most: float) -> set[_Element]:
        out: set[_Element] = set()
        for n in named:
            if outer[n] in out or n not in holders and least * total < held[n] <= most * total:
                out.add(n)
        return {n for n in size if around[n] in out}

    gone = within(-1.0, SMALL_SHARE)
    if sum(k for n, k in size.items() if n not in gone) < LEAST_REST * total:
        return set(), set()
    return gone, within(SMALL_SHARE, HALF)


def path_scores(blocks: list[_Block]) -> tuple[list[float], list[float]]:
    """Scores of the blocks, their paths' text ratio times punctuation ratio: smoothed, and as they are."""
    sums: dict[int, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.element.path, [0, 0, 0])
        s[0] += max(len(b.text) - b.linked, 0)
        s[1] += sum(map(b.text.count, PUNCTUATION))
        s[2] += 1
    text = [sums[b.element.path][0] / sums[b.element.path][2] for b in blocks]
    marks = [sums[b.element.path][1] / sums[b.element.path][2] for b in blocks]

    def fused(text: list[float], marks: list[float]) -> list[float]:
        weight = [MAIN_FACTOR if b.element.main and not b.lowered else 1 for b in blocks]
        return [log1p(t) * log1p(1 + m) * w for t, m, w in zip(text, marks, weight, strict=True)]

    return fused(_smooth(text), _smooth(marks)), fused(text, marks)


def _smooth(values: list[float], sigma: float = SMOOTHING) -> list[float]:
    weights = [exp(-((k / sigma) ** 2) / 2) for k in range(-2, 3)]
    out = []
    for i in range(len(values)):
        near = [(values[j], w) for j, w in zip(range(i - 2, i + 3), weights, strict=True) if 0 <= j < len(values)]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def main_text(html: str | None) -> str:
    """The article of a page: block texts in page order, joined by one space."""
    blocks = text_blocks(html) if html else []
    if not blocks:
        return ""
    scores, alone = path_scores(blocks)
    mean = sum(scores) / len(scores)
    spread = sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    least = mean - THRESHOLD * spread
    best, highest = max(scores), max(alone)
    found = [
        s >= max(least, best / MAIN_FACTOR) and a >= highest / MAIN_FACTOR for s, a in zip(scores, alone, strict=True)
    ]
    if not any(found):
        found = [a == highest for a in alone]
    article = _shared([b.element for b, f in zip(blocks, found, strict=True) if f])
    while article.tag in LONE:  # a lone paragraph's parent holds it
        article = article.parent
    marked = article
    while marked is not None and not marked.marked:
        marked = marked.parent
    article = marked or article
    named = any(b.lowered for b, f in zip(blocks, found, strict=True) if f)
    inside = [(b, f) for b, f in zip(blocks, found, strict=True) if (named or not b.lowered) and _inside(b.element, article)]
    first = next(i for i, (_, f) in enumerate(inside) if f)
    last = max(i for i, (_, f) in enumerate(inside) if f)
    flow = {article: True}
    return " ".join(
        b.text
        for i, (b, f) in enumerate(inside)
        if f or not _mostly_links(b) and (article.marked or first < i < last or _in_flow(b.element, flow))
    )


def _in_flow(node: _Element, known: dict[_Element, bool]) -> bool:
    """Whether only elements of running text lie between an element and the article; ``known``
    has the answers so far, that of the article first."""
    way = []
    while node not in known:
        way.append(node)
        node = node.parent
    answer = known[node]
    for n in reversed(way):
        answer = known[n] = answer and n.tag in FLOW
    return answer


def _mostly_links(block: _Block) -> bool:
    return 2 * block.linked > len(block.text)


def _shared(elements: list[_Element]) -> _Element:
    """The deepest element that holds all: the first one's nearest parent that ends behind the last."""
    last = max(e.number for e in elements)
    node = min(elements, key=lambda e: e.number)
    while node.last < last:
        node = node.parent
    return node


def _inside(node: _Element, top: _Element) -> bool:
    return top.number <= node.number <= top.last


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def extract(rows: Iterable[tuple]) -> Iterator[tuple]:
        for page, url, html in rows:
            text = main_text(html)
            yield page, url, text, len(text)

    id_type = slim.schema["page_id"].dataType.simpleString()
    return map_rows(slim, extract, f"page_id {id_type}, url string, text string, n_chars long", 1000)
