"""Main text of web pages by line-block distribution.

A page is stripped of markup into lines, one for each block element's text. A line's block sum is
the text length of the lines in a window that starts at it; it surges where a text begins and dives where it
ends, and the run between surge and dive with the most text is the core. Lines of menus, headers,
footers, sidebars, forms, adverts, notices and comments have no length, nor have, outside an article element, lines
that are mostly links.

The core then widens to the containers that it spans, so that short first and last lines stay. If most of
the core's text lies in article or main elements, the result is made of these: each one, siblings as well, of which a
run holds text enough for a surge of its own. Otherwise the core, and runs with a quarter of its text, widen each to its innermost
container, and all between the first and the last of them is text.

What elements and roles say of a part is taken as it is. Class and id names count only where they
name a part: as a whole name or a compound of such words, and not if nothing else would be left. Names that an article's own
parts may bear as well (related, share, a paragraph called widget) decide nothing alone: such a part goes if at least half of
its text is links. Everything is done once per tag or line, so deep nesting costs no more than long pages do.

Edge cases: a null or empty html gives an empty text; unclosed and stray tags, cut pages and
unquoted attributes are read as browsers would roughly do; formulas, fallback texts of embedded objects and table cells
are text, form controls and what shows without scripts only are not; a page without text gives an empty
text; rows that repeat give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tidalframe.llm.common import lean, prepare, slices

WINDOW = 3
#: Share of the largest block sum below which a line lies outside.
FLOOR = 0.08
#: Share of the core's text from which another run outside article elements belongs to the text.
ALSO = 0.25
#: Characters of a line that count towards the largest block sum, so one very long line doesn't drown the others.
LINE = 1000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|select|button|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>.*?(?:</\1\s*[^>]*>|\Z)|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")

_CONTAINERS = frozenset("html head body div section article main aside nav header footer form fieldset ul ol dl table tbody thead tfoot figure details dialog menu blockquote".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr pre address figcaption hr caption summary center".split())
_CELLS = frozenset(("td", "th", "br"))
_OUTSIDE = frozenset("head nav aside footer form dialog menu header".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words that name page parts other than the article; fixed values.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo banner nav navbar navigation menu submenu sidebar "
    "footer masthead breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments "
    "disqus replies widget widgets toolbar".split()
)
#: Those of them that also name a text block that is no container; fixed values.
_PLAIN = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo cookie cookies gdpr newsletter comment comments disqus replies".split())
#: Words that do so alone on a container, or together with one another; fixed values.
_WEAK = frozenset("notice promotion reply respond disclaimer copyright".split())
#: Words that do so in compounds, and alone for parts that are mostly links; fixed values.
_LINKS = frozenset("related recommended recommendations share sharing social skip".split())
#: Words that may stand beside those in a compound name; fixed values.
_BESIDE = frozenset("site page post posts article articles user reader top bottom left right main list box bar block area section wrapper container inner body content links link buttons button icons form text header slot unit break row".split())
_REPLIES = frozenset(("comment", "comments", "reply", "replies"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class _Node:
    """An open container: whether it or what holds it lies outside (by element, by name), the outermost article.

    ``tally`` is [characters, those in links] of the outermost part whose name decides only with its links.
    """

    __slots__ = ("tag", "out", "named", "home", "header", "tally")

    def __init__(self, tag: str, parent, out: bool = False, named: bool = False, tally: list[int] | None = None):
        self.tag = tag
        self.out = out or (parent is not None and parent.out)
        self.named = named or (parent is not None and parent.named)
        self.home = (parent.home if parent is not None else None) or (self if tag in ("article", "main") else None)
        self.header = tag == "header" or (parent is not None and parent.header)
        self.tally = (parent.tally if parent is not None else None) or tally


class Line(NamedTuple):
    """Text of a block; ``low`` is the least depth of open containers since the line before."""

    text: str
    out: bool
    named: bool
    heading: bool
    links: int
    home: _Node | None
    header: bool
    depth: int
    low: int
    tally: list[int] | None


def names_a_part(value: str, container: bool) -> tuple[bool, bool]:
    """Whether a class or id names a page part that isn't the article, and whether it does if the part is mostly links."""
    names = value.split()
    if_links = False
    for name in names:
        parts = [p for p in _SPLIT.split(name) if p]
        if not parts:
            continue
        if len(parts) == 1:
            if parts[0] in (_NAMES if container else _PLAIN) or (container and len(names) == 1 and parts[0] in _WEAK):
                return True, False
            if_links |= parts[0] in _NAMES or (container and len(names) == 1 and parts[0] in _LINKS)
        else:
            known = [p for p in parts if p in _NAMES or p in _WEAK or p in _LINKS]
            if known and all(p in known or p in _BESIDE or p.isdigit() for p in parts):
                return True, False
    return False, if_links


def _outside(tag: str, attributes: str, parent: _Node) -> tuple[bool, bool, list[int] | None]:
    """Whether an element lies outside the article by what it is, by its names, by them if its tally is mostly links."""
    if tag == "header" and parent.home is None:
        return True, False, None
    if tag in _OUTSIDE and tag != "header":
        return True, False, None
    if not attributes or tag in ("html", "body"):
        return False, False, None
    named = if_links = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in _ROLES):
            return True, False, None
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False, None
        if name in ("class", "id"):
            if tag in ("article", "main"):
                named |= not _REPLIES.isdisjoint(value.split())
            else:
                whole, perhaps = names_a_part(value, tag in _CONTAINERS)
                named, if_links = named or whole, if_links or perhaps
    return False, named, [0, 0] if if_links else None


def lines(page: str) -> list[Line]:
    """The blocks of the page that have text."""
    stack = [_Node("", None)]
    opened: Counter[str] = Counter()
    out: list[Line] = []
    held: list[str] = []
    heading = linked = False
    links = low = 0
    skip: list[tuple[str, bool, bool, list[int] | None]] = []  # open block elements, not containers, that lie outside

    def take(text: str) -> None:
        nonlocal links
        held.append(entities.unescape(text))
        if linked:
            links += len(held[-1].strip())

    def flush() -> None:
        nonlocal held, links, low
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            if text:
                node = stack[-1]
                _, gone, named, tally = skip[-1] if skip else ("", False, False, None)
                tally = node.tally or tally
                if tally is not None:
                    tally[0] += len(text)
                    tally[1] += links
                out.append(Line(text, node.out or gone, node.named or named, heading, links, node.home, node.header, len(stack), min(low, len(stack)), tally))
                low = len(stack)
            held = []
        links = 0

    def close(*tags: str) -> None:
        """Close the innermost of ``tags`` that is open, and all inside it."""
        nonlocal low
        if any(opened[t] for t in tags):
            while True:
                node = stack.pop()
                opened[node.tag] -= 1
                if node.tag in tags:
                    break
            low = min(low, len(stack))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "a":
            linked = not m[2]
        if tag in _CELLS:
            held.append(" ")
        if tag not in _BLOCKS:
            continue
        flush()
        if skip and (tag == skip[-1][0] or tag in _CONTAINERS):
            skip.pop()
        if m[2]:
            if tag in _HEADINGS:
                heading = False
            if tag in _CONTAINERS:
                linked = False
                close(tag)
        else:
            heading = tag in _HEADINGS
            if tag in ("article", "main"):
                close("nav", "header", "head")  # left open
            if tag in _CONTAINERS:
                if not m[5]:
                    stack.append(_Node(tag, stack[-1], *_outside(tag, m[4], stack[-1])))
                    opened[tag] += 1
            elif m[4] and any(flags := _outside(tag, m[4], stack[-1])):
                skip.append((tag, *flags))
    if at < len(page):
        take(page[at:])
    flush()
    return out


def runs(sizes: list[int], window: int = WINDOW, floor: float = FLOOR) -> tuple[float, list[tuple[int, int]]]:
    """The block sum that makes a surge, and first line and end of each run between surge and dive."""
    upto = [0, *accumulate(sizes)]
    capped = [0, *accumulate(min(x, LINE) for x in sizes)]
    n = len(sizes)
    least = max(1.0, floor * max((capped[min(n, i + window)] - capped[i] for i in range(n)), default=0))
    out, began = [], None
    for i in range(n + 1):
        high = i < n and upto[min(n, i + window)] - upto[i] >= least
        if high and began is None:
            began = i
        elif not high and began is not None:
            out.append((began, i))
            began = None
    return least, out


def core(sizes: list[int], window: int = WINDOW, floor: float = FLOOR) -> tuple[int, int]:
    """First line and end of the run between surge and dive with the most text, the first of equals."""
    return max(runs(sizes, window, floor)[1], key=lambda r: sum(sizes[r[0] : r[1]]), default=(0, 0))


def _spanned(lines: list[Line], prose: list[bool], window: int, floor: float) -> list[bool]:
    """Of each line, whether the containers that the core spans hold it."""
    at = [k for k, ok in enumerate(prose) if ok]
    sizes = [len(lines[k].text) for k in at]
    least, found = runs(sizes, window, floor)
    texts = [sum(sizes[i:j]) for i, j in found]
    main = max(range(len(found)), key=texts.__getitem__)
    held: Counter[int] = Counter()  # characters that the runs hold of each article
    for i, j in found:
        for k in range(i, j):
            if lines[at[k]].home is not None:
                held[id(lines[at[k]].home)] += sizes[k]
    first, end = found[main]
    if 2 * sum(sizes[k] for k in range(first, end) if lines[at[k]].home is not None) >= texts[main]:
        return [x.home is not None and held[id(x.home)] >= least for x in lines]
    also = [r for r, text in zip(found, texts, strict=True) if text >= ALSO * texts[main]]
    lo, hi = (_widened(lines, at[i], at[j - 1]) for i, j in (also[0], also[-1]))
    return [lo[0] <= k <= hi[1] and ok for k, ok in enumerate(prose)]


def _widened(lines: list[Line], lo: int, hi: int) -> tuple[int, int]:
    """First and last line of the innermost container that holds the lines from ``lo`` to ``hi``."""
    depth = min([lines[lo].depth, *(x.low for x in lines[lo + 1 : hi + 1])])
    while lo and lines[lo].low >= depth:
        lo -= 1
    while hi + 1 < len(lines) and lines[hi + 1].low >= depth:
        hi += 1
    return lo, hi


def main_text(page: str | None, window: int = WINDOW, floor: float = FLOOR) -> str:
    """The article's blocks, joined by an empty line."""
    every = lines(page or "")
    for by_name in (True, False):
        fits = [not x.out and not (by_name and (x.named or (x.tally is not None and 2 * x.tally[1] >= x.tally[0]))) and (x.heading or not x.header) for x in every]
        if any(fits):
            break
    else:
        return ""
    prose = [ok and (x.home is not None or 2 * x.links <= len(x.text)) for x, ok in zip(every, fits, strict=True)]
    if not any(prose):
        prose = fits
    spanned = _spanned(every, prose, window, floor)
    return "\n\n".join(x.text for x, ok, inside in zip(every, fits, spanned, strict=True) if ok and inside)


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    given = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return given.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
