"""Web pages as columns: a page is an array of nodes with interval numbers.

``with_nodes`` adds ``nodes``, the elements, texts and comments of a page in document order. An
element covers the nodes from its own number ``at`` up to, not including, its ``end``; a text or
comment covers itself. That is all Python does: it splits markup into nodes. Selecting elements
and reading their texts are column expressions over those numbers, so a query computes only the
fields it asks for.

Reading is as tolerant as a browser's: quotes, upper-case tags and character references follow
HTML; markup that is nothing known ends at the next ``>`` and the page goes on behind it. End
tags that HTML lets out are implied (rows, cells, list items, paragraphs, ...), an end tag does
not close an element that outranks it, and elements left open end with the page. Of a repeated
attribute the last counts. Comments are nodes but no text, nor are the contents of scripts,
styles and templates a text of what is around them. The work is linear in the page's length,
however deep its elements are nested.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset(("script", "style"))
HIDDEN_TEXT = frozenset(("script", "style", "template"))

_ROW_PARTS = ("td", "th", "tr", "caption", "colgroup")
_SECTIONS = ("thead", "tbody", "tfoot")
# A start tag ends the open elements named first, back to the nearest one named second.
IMPLIED_ENDS = {
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (_ROW_PARTS, ("table",)),
    "li": (("li",), ("ul", "ol", "table")),
    "dt": (("dt", "dd"), ("dl", "table")),
    "dd": (("dt", "dd"), ("dl", "table")),
    "option": (("option",), ("select", "table")),
    "optgroup": (("option", "optgroup"), ("select", "table")),
    **{s: ((*_ROW_PARTS, *_SECTIONS), ("table",)) for s in _SECTIONS},
    **{
        block: (("p",), ("td", "th", "table", "li", "button"))
        for block in (
            "p div ul ol dl table form fieldset article aside section nav header footer main address "
            "blockquote pre h1 h2 h3 h4 h5 h6 hr"
        ).split()
    },
}
# An end tag is ignored where an element of a higher rank is open inside its element.
RANKS = {"div": 1, "td": 2, "th": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4, "table": 5, "head": 6, "body": 6, "html": 7}
HIGHER = {tag: [t for t, r in RANKS.items() if r > rank] for tag, rank in RANKS.items()}

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))
      | <(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)
        (?P<attrs>(?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+)*+)[\s/]*+>
      | <[!?/][^>]*+>""",
    re.DOTALL | re.VERBOSE,
)
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]*+)))?+""")


def _attributes(source: str) -> dict[str, str]:
    out = {}
    for name, *values in _ATTRIBUTE.findall(source):
        value = values[0] or values[1] or values[2]
        out[name.lower()] = unescape(value) if "&" in value else value
    return out


class _Page:
    """The nodes of one page as lists, one for each field."""

    def __init__(self, html: str) -> None:
        self.end: list[int] = []
        self.tag: list[str | None] = []
        self.id: list[str | None] = []
        self.css: list[str | None] = []
        self.href: list[str | None] = []
        self.text: list[str | None] = []
        self.shown: list[bool] = []
        self._open: list[int] = []  # open elements, outermost first
        self._depths: dict[str, list[int]] = {}  # of each tag, its places among them
        self._read(html)
        self._close_from(0)

    def _add(self, tag: str | None = None, attrs: dict | None = None, text: str | None = None, shown: bool = False) -> None:
        self.end.append(len(self.end) + 1)
        self.tag.append(tag)
        self.text.append(text)
        self.shown.append(shown)
        if attrs:
            self.id.append(attrs.get("id"))
            self.href.append(attrs.get("href"))
            css = attrs.get("class")
            self.css.append(None if css is None else f" {' '.join(css.split())} ")
        else:
            self.id.append(None)
            self.href.append(None)
            self.css.append(None)

    def _close_from(self, depth: int) -> None:
        while len(self._open) > depth:
            at = self._open.pop()
            self.end[at] = len(self.end)
            self._depths[self.tag[at]].pop()

    def _deepest(self, tags: Iterable[str]) -> int:
        return max((self._depths[t][-1] for t in tags if self._depths.get(t)), default=-1)

    def _start(self, tag: str, attrs: dict, alone: bool) -> None:
        if tag in IMPLIED_ENDS:
            ended, back_to = IMPLIED_ENDS[tag]
            started = [places for t in ended if (places := self._depths.get(t))]
            if started:
                fence = self._deepest(back_to)
                if (found := [p[i] for p in started if (i := bisect_right(p, fence)) < len(p)]):
                    self._close_from(min(found))
        at = len(self.end)
        self._add(tag, attrs)
        if tag not in VOID_TAGS and not alone:
            self._depths.setdefault(tag, []).append(len(self._open))
            self._open.append(at)

    def _finish(self, tag: str) -> None:
        places = self._depths.get(tag)
        if not places:
            return
        at = places[-1]
        if at == len(self._open) - 1 or self._deepest(HIGHER.get(tag, RANKS)) < at:
            self._close_from(at)

    def _write(self, text: str, raw: bool = False) -> None:
        if not text:
            return
        if not raw and "&" in text:
            text = unescape(text)
        hidden = bool(self._open) and self.tag[self._open[-1]] in HIDDEN_TEXT
        self._add(text=text, shown=not hidden)

    def _read(self, html: str) -> None:
        at, limit = 0, html.rfind(">") + 1
        while (token := _TOKEN.search(html, at, limit)) is not None:
            self._write(html[at : token.start()])
            at = token.end()
            tag = token["tag"]
            if tag is None:
                if not token[0][:9].lower() == "<!doctype":
                    self._add(text=token[0].removeprefix("<!--").removesuffix("-->"))
                continue
            tag = tag.lower()
            if token["end"]:
                self._finish(tag)
                continue
            source = token["attrs"]
            alone = token[0].endswith("/>")
            self._start(tag, _attributes(source) if source else {}, alone)
            if tag in RAW_TEXT and not alone:
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
                end = stop.start() if stop else len(html)
                self._write(html[at:end], raw=True)
                at = end
                limit = max(limit, at)
        self._write(html[at:])


NODE = "struct<at:int,end:int,tag:string,id:string,css:string,href:string,text:string,shown:boolean>"
_FIELDS = [("at", pa.int32()), ("end", pa.int32()), *((n, pa.string()) for n in ("tag", "id", "css", "href", "text")), ("shown", pa.bool_())]

# Characters of markup that a task holds as nodes at a time, unless one page has more.
PAGE_CHARS = 4 << 20


def _node_array(pages: list[str | None]) -> pa.ListArray:
    """The nodes of some pages as one Arrow array (a NULL page has none)."""
    offsets, columns = [0], {name: [] for name, _ in _FIELDS}
    for html in pages:
        page = _Page(html or "")
        columns["at"].extend(range(len(page.end)))
        for name, _ in _FIELDS[1:]:
            columns[name].extend(getattr(page, name))
        offsets.append(len(columns["at"]))
    fields = [pa.array(columns[name], kind) for name, kind in _FIELDS]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, [n for n, _ in _FIELDS]))


def with_nodes(pages: DataFrame, html_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``nodes`` of every page."""
    types = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"nodes array<{NODE}>"])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                pages, size = [], 0
                while at + len(pages) < batch.num_rows and (not pages or size < PAGE_CHARS):
                    pages.append(batch.column(batch.num_columns - 1)[at + len(pages)].as_py())
                    size += len(pages[-1] or "")
                own = batch.slice(at, len(pages))
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], _node_array(pages)], [*keep, "nodes"])
                at += len(pages)

    return pages.select(*keep, html_col).mapInArrow(read, schema)


# --- expressions over ``nodes`` as SQL text; an element is a node struct, NULL where there is none
# Text, as a query has a hundred of them: Spark parses them at once, where building each by
# calls takes seconds.

# What Python's strip() and split() take as white space.
SPACE = r"[\s\x1c-\x1f]"

_names = itertools.count()


def literal(text: str) -> str:
    """A text as an SQL literal."""
    return "r'" + text + "'" if "'" not in text else 'r"' + text + '"'


def let(value: str, body: Callable[[str], str]) -> str:
    """``body(value)`` with the value computed once, however often the body names it."""
    name = f"v{next(_names)}"
    return f"get(transform(array({value}), {name} -> {body(name)}), 0)"


def elements(nodes: str, tag: str | None = None, id_: str | None = None, css: str | None = None) -> str:
    """The elements of some nodes with a tag, an id and a class, in document order.

    One class name is looked for among an element's; several must be just those.
    """
    name = f"n{next(_names)}"
    wanted = [f"{name}.tag = {literal(tag)}" if tag else f"{name}.tag IS NOT NULL"]
    if id_ is not None:
        wanted.append(f"{name}.id = {literal(id_)}")
    if css is not None:
        names = literal(f" {' '.join(css.split())} ")
        wanted.append(f"{name}.css = {names}" if " " in css.strip() else f"contains({name}.css, {names})")
    return f"filter({nodes}, {name} -> coalesce({' AND '.join(wanted)}, false))"


def first(nodes: str, tag: str | None = None, id_: str | None = None, css: str | None = None) -> str:
    return f"get({elements(nodes, tag, id_, css)}, 0)"


def inside(element: str) -> str:
    """The nodes that an element covers, itself left out; the cost is that of those alone."""
    name = f"i{next(_names)}"
    covered = f"transform(sequence({element}.at + 1, {element}.end - 1), {name} -> get(nodes, {name}))"
    return f"CASE WHEN {element}.end > {element}.at + 1 THEN {covered} WHEN {element} IS NOT NULL THEN slice(nodes, 1, 0) END"


def strip(text: str) -> str:
    return f"regexp_replace({text}, {literal(rf'(?U)^{SPACE}++|(?<!{SPACE}){SPACE}++$')}, '')"


def strings(nodes: str) -> str:
    """The shown texts among some nodes."""
    a, b = f"n{next(_names)}", f"n{next(_names)}"
    return f"transform(filter({nodes}, {a} -> {a}.shown), {b} -> {b}.text)"


def text(element: str) -> str:
    """The stripped text of an element; NULL without one."""
    return let(element, lambda e: strip(f"array_join({strings(inside(e))}, '')"))


def only_string(element: str) -> str:
    """The stripped string of an element that holds one string alone, however deep; else NULL."""

    def of(e: str) -> str:
        # One child inside another down to the string: all end where the element does.
        n = f"n{next(_names)}"
        within = f"filter({inside(e)}, {n} -> {n}.end <> {e}.end OR {n}.at = {e}.end - 1)"
        return let(within, lambda w: f"CASE WHEN size({w}) = 1 AND get({w}, 0).tag IS NULL THEN {strip(f'get({w}, 0).text')} END")

    return let(element, of)
