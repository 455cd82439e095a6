"""Main text of web pages by tag-path ratios.

A page is read as a tree (tolerantly: missing end tags, unclosed inline elements, raw text elements), in time linear in its
length, however deep it is. Elements that are no text of an article by their kind (navigation, page header and footer,
asides, forms, dialogs, hidden ones) are left out. The rest is blocks: runs of inline content with a root-to-leaf tag path. Names
in class or id are a feature, not a filter: a path's steps tell whether they name page furniture for certain or perhaps.

1. *Aggregate*: for each path, the mean text length, the mean punctuation and the share of links of its blocks.
2. *Fuse*: a path's ratio is length / (length + 80) * (1 + punctuation / (punctuation + 3)) * (1 - share of links), so
   paragraphs of one article share a ratio, and very long ones don't outweigh the rest.
3. *Smooth*: blocks take a Gaussian mean of their neighbours' ratios in page order, paths the mean of their blocks.
   The result is multiplied by ``WEAK`` or ``STRONG`` where a step's names speak against it.
4. *Threshold*: paths that reach ``CUT`` times the mean ratio, weighted by text and names, are content; all their blocks are main text.

Blocks of other paths get a bonus that takes them over the threshold if nothing speaks against them and they are kin of
content: the lowest element around them that holds content holds them as text (a heading, paragraph, list, table, quotation or
bare text, not by a div or section of their own), and they stand between content blocks or in an article or main element. A
heading in an element of its own is kin if content comes next. Lists of links get no bonus.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import slices, tidy
from tarn.sources.spread import spread

#: Share of the mean ratio that a content path reaches.
CUT = 0.4
#: Length and punctuation at which a path gets half of what they can give.
HALF_LENGTH, HALF_MARKS = 80, 3
#: Factors of names that perhaps, and for certain, mean furniture; and the ratio from which a block is prose.
WEAK, STRONG, PROSE = 0.5, 0.05, 0.4
#: Weight of a block's neighbours.
NEIGHBOURS = 0.3
_KERNEL = [math.exp(-(k * k) / 2) for k in range(3)]
_PUNCTUATION = re.compile(r"[.,;:!?…،。，；：！？、]")
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>?"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<start2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>?",
    re.S,
)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# Names of the HTML standard.
_RAW = frozenset("script style noscript textarea title xmp iframe noembed noframes template svg math object audio video canvas".split())
_SHOWN_UNCLOSED = frozenset("noscript object audio video canvas svg math iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset("option optgroup td th tr tbody thead tfoot body html".split())
_KEEPS_P = ("td", "th", "button", "caption", "table")
_SIBLING_END = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",))}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Containers that say nothing of the text they hold.
_GENERIC = frozenset("div section center article main body html details td tr tbody table".split())
# Elements and roles that are no text of an article, and words in class or id that name page furniture for certain or perhaps.
_DROP_TAGS = frozenset("nav aside form footer button select option menu dialog fieldset input label head".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
_STRONG_WORDS = frozenset(
    "ad ads adbox adsense adslot advert adverts advertisement advertising sponsored promo promoted promotion banner banners cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login paywall"
    " share sharing social sidebar nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus pagination pager copyright".split()
)
_WEAK_WORDS = frozenset("sponsor sponsors notification notifications alert subscription register related recommended recommendations aside widget widgets respond reply replies discussion toolbar skip search disclaimer".split())
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


class _Element:
    __slots__ = ("tag", "parent", "path", "named", "drop", "headings", "block", "home", "holds_article", "owner", "content", "factor")

    def __init__(self, tag: str, parent: _Element | None, path: int, named: int, drop: bool, headings: bool):
        self.tag, self.parent, self.path, self.named, self.drop, self.headings = tag, parent, path, named, drop, headings
        self.block = self if parent is None or tag in _BLOCK else parent.block
        self.home = tag in ("article", "main") or parent is not None and parent.home
        self.holds_article, self.owner, self.content, self.factor = False, None, False, 1.0


class _Block:
    """A run of inline content."""

    __slots__ = ("element", "pieces", "heading", "size", "marks", "linked", "ratio", "path")

    def __init__(self, element: _Element, heading: bool):
        self.element, self.heading, self.pieces, self.linked = element, heading, [], 0

    def measure(self) -> None:
        squeezed = "".join("".join(self.pieces).split())
        self.size, self.marks = len(squeezed), len(_PUNCTUATION.findall(squeezed))


def _names(value: str) -> int:
    """2: a name means furniture for certain, 1: perhaps, 0: not. At least half of a name's words have to say so for 2."""
    found = 0
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        strong = sum(w in _STRONG_WORDS for w in words)
        if strong and 2 * strong >= len(words):
            return 2
        if strong or not _WEAK_WORDS.isdisjoint(words):
            found = 1
    return found


def _said(tag: str, attrs: str) -> tuple[bool, int, bool]:
    """Whether an element is no text by its kind, what its names say, and whether it is a header."""
    drop, named, head = tag in _DROP_TAGS, 0, tag == "header"
    if attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                drop |= value.strip().lower() in _DROP_ROLES
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                drop = True
            elif name in ("class", "id"):
                named = max(named, _names(value))
                head |= any(_WORD.findall(n.lower())[:1] == ["header"] for n in value.split())
    return drop, named, head


class _Reader:
    """The elements (parents first) and the blocks of a page. Where a tag is open is looked up, so depth costs nothing."""

    def __init__(self, page: str):
        self.root = _Element("", None, 0, 0, False, False)
        self.elements, self.blocks = [self.root], []
        self.stack = [self.root]
        self.open: dict[str, list[int]] = {}
        self.of_blocks = [0]  # places of open block elements
        self.paths: dict[tuple[int, str, int], int] = {}
        self.run: _Block | None = None
        self.links = self.heads = 0
        self.endless: set[str] = set()
        self.read(page)

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of these tags; -1 if none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def close(self, until: int) -> None:
        while len(self.stack) > until:
            gone = self.stack.pop()
            self.open[gone.tag].pop()
            self.links -= gone.tag == "a"
            self.heads -= gone.tag in _HEADINGS
            if gone.tag in _BLOCK:
                self.of_blocks.pop()
                self.run = None

    def add(self, raw: str) -> None:
        element = self.stack[-1]
        if not raw or element.drop or element.headings and not self.heads:
            return
        if self.run is None:
            if not raw.strip():
                return
            self.run = _Block(element.block, self.heads > 0)
            self.blocks.append(self.run)
        text = html.unescape(raw)
        self.run.pieces.append(text)
        if self.links:
            self.run.linked += len("".join(text.split()))

    def start(self, tag: str, attrs: str) -> None:
        if tag in _CLOSES_P and (at := self.last("p")) > self.last(*_KEEPS_P):
            self.close(at)
        if tag in _SIBLING_END:
            ends, stops = _SIBLING_END[tag]
            stop = self.last(*stops)
            found = [at for at in (self.last(t) for t in ends) if at > stop]
            if found:
                self.close(min(found) if tag == "tr" else max(found))
        if tag == "a" and (at := self.last("a")) > self.of_blocks[-1]:
            self.close(at)
        if tag in ("html", "body") and self.open.get(tag):
            return
        parent = self.stack[-1]
        drop, named, head = _said(tag, attrs)
        if tag in ("html", "body", "main"):
            drop, named = False, 0
        elif head and not parent.home and tag != "article":
            named = 2
        if tag in ("article", "main"):
            e = parent
            while e is not None and not e.holds_article:
                e.holds_article = True
                e = e.parent
        step = (parent.path, tag, named)
        own = _Element(tag, parent, self.paths.setdefault(step, len(self.paths) + 1), named, drop or parent.drop, parent.headings or head and parent.home and tag not in ("article", "main"))
        self.elements.append(own)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.links += tag == "a"
        self.heads += tag in _HEADINGS
        if tag in _BLOCK:
            self.of_blocks.append(len(self.stack))
            self.run = None
        self.stack.append(own)

    def end(self, tag: str) -> None:
        if tag == "p" and not self.open.get("p"):
            self.run = None
        if tag not in ("body", "html") and (at := self.last(tag)) >= 0 and (tag in _BLOCK or at > self.of_blocks[-1]):
            self.close(at)  # an inline end tag doesn't close blocks

    def read(self, page: str) -> None:
        at, size = 0, len(page)
        while at < size:
            lt = page.find("<", at)
            if lt < 0:
                self.add(page[at:])
                break
            m = _TOKEN.match(page, lt)
            if m is None:
                self.add(page[at : lt + 1])
                at = lt + 1
                continue
            self.add(page[at:lt])
            at = m.end()
            if m["end"]:
                self.end(m["end"].lower())
                continue
            tag, attrs = (m["start"] or m["start2"] or "").lower(), m["attrs"] or m["attrs2"] or ""
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self.add(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            elif tag in _VOID:
                if tag == "hr":
                    self.run = None
                elif tag == "br":
                    self.add(" ")
            elif tag in _RAW:
                if attrs.endswith("/") and tag in ("svg", "math"):
                    continue
                end = None if tag in self.endless else re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                if end is None:
                    self.endless.add(tag)
                    if tag in _SHOWN_UNCLOSED:
                        continue  # never closed: its content is shown
                at = end.end() if end else size
            else:
                self.start(tag, attrs)


def _fused(length: float, marks: float, linked: float) -> float:
    return length / (length + HALF_LENGTH) * (1 + marks / (marks + HALF_MARKS)) * (1 - linked)


def _weigh(reader: _Reader, blocks: list[_Block]) -> None:
    """Factors of names. Names of an element that holds an article say nothing, nor do those around the most prose if all prose is in named elements."""
    for e in reader.elements[1:]:
        e.owner = e if e.named == 2 and not e.holds_article else e.parent.owner
    prose: dict[_Element | None, int] = {}
    for b in blocks:
        e = b.element
        if _fused(b.size, b.marks, b.linked / b.size) >= PROSE or e.home and e.owner is None:
            prose[e.owner] = prose.get(e.owner, 0) + 1
    wrappers = set()
    if prose and None not in prose:
        e = max(prose, key=prose.get)
        while e is not None:
            wrappers.add(e)
            e = e.parent
    for e in reader.elements[1:]:
        e.factor = e.parent.factor if e.holds_article or e in wrappers else min(e.parent.factor, (1.0, WEAK, STRONG)[e.named])


def _content(blocks: list[_Block]) -> set[tuple[int, float]]:
    """Paths (with the factors of their names) whose smoothed, fused ratio reaches the threshold."""
    sums: dict[tuple[int, float], list[float]] = {}
    for b in blocks:
        b.path = (b.element.path, b.element.factor)
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        for k, v in enumerate((1, b.size, b.marks, b.linked)):
            s[k] += v
    fused = {p: _fused(size / n, marks / n, linked / size) for p, (n, size, marks, linked) in sums.items()}
    raw = [fused[b.path] for b in blocks]
    smooth: dict[tuple[int, float], float] = dict.fromkeys(sums, 0.0)
    for k, b in enumerate(blocks):
        near = [(_KERNEL[abs(d)], raw[k + d] * blocks[k + d].path[1]) for d in range(-2, 3) if 0 <= k + d < len(raw)]
        smooth[b.path] += (1 - NEIGHBOURS) * raw[k] + NEIGHBOURS * sum(w * r for w, r in near) / sum(w for w, _ in near)
    ratio = {p: smooth[p] / s[0] * p[1] for p, s in sums.items()}
    total = sum(s[1] * p[1] for p, s in sums.items())
    mean = sum(ratio[p] * s[1] * p[1] for p, s in sums.items()) / total
    return {p for p, r in ratio.items() if r >= CUT * mean}


def _kin(b: _Block, following: bool, between: bool) -> bool:
    """Whether a block that isn't content belongs to content around it; ``following``: content comes next, ``between``: and came before."""
    if b.element.factor < 1 or b.linked > 0.6 * b.size and not b.heading:
        return False
    e, own = b.element, None
    while not e.content:
        own, e = e, e.parent
    if not between and not e.home and e.tag in ("", "html", "body"):
        return False
    if own is None or own.tag not in _GENERIC and own.tag not in ("header", "hgroup"):
        return True
    return b.heading and (following or own.home)


def main_text(page: str | None) -> str:
    """The main text of one page; empty if the page has none."""
    if not page:
        return ""
    reader = _Reader(page)
    for b in reader.blocks:
        b.measure()
    blocks = [b for b in reader.blocks if b.size]
    if not blocks:
        return ""
    _weigh(reader, blocks)
    content = _content(blocks)
    for b in blocks:
        e = b.element
        while b.path in content and e is not None and not e.content:
            e.content = True
            e = e.parent
    where = [k for k, b in enumerate(blocks) if b.path in content]
    out, nexts = [], 0
    for k, b in enumerate(blocks):
        if b.path not in content:
            while nexts < len(where) and where[nexts] < k:
                nexts += 1
            ahead = where[nexts] if nexts < len(where) else None
            following = ahead is not None and all(x.heading for x in blocks[k + 1 : ahead])
            if not _kin(b, following, where[0] < k < where[-1]):
                continue
        out.append(" ".join("".join(b.pieces).split()))
    return " ".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): the main text of every row, from columns page_id, url and html alone.

    Null and empty pages, and pages without text, have the empty text. Repeated rows each give a row, null ids and
    urls are passed on, and an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, text="html"):
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array([main_text(p) for p in part.column("html").to_pylist()], pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return spread(rows).mapInArrow(tidy(run), "page_id long, url string, text string")
