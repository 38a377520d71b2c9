"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one per block of text, by one forward pass. Menus, headers, footers, sidebars, notices, adverts, forms,
comments, scripts and styles that a page marks as such (by element, or by a name in class, id or role) become empty
lines, and the borders of sections runs of empty lines. A line weighs as many characters as it has, with links in it the letters and digits outside them; lines
of a few copyright phrases weigh nothing. Where a page marks its article (<article>, <main>), a line in it weighs SURGE more, and lines
outside weigh nothing.

Every page is then read off the same distribution. Weights are summed over sliding windows of WINDOW lines. Where a sum rises from zero
a region begins, where it falls to zero the region dives. A region surges if a sum reaches the page's threshold, half of its largest
sum or SURGE, whichever is less. The text is what stands between the first surge and the last dive. Lighter regions before or after it are
kept if the element that holds the surges holds them too, and they hold a heading or a whole sentence; so are headings before
it. Weightless lines at the ends of a region go: menus without a mark are links, imprints are neither.

An <article> or <main> that stands in a part with such a name is read where no other is found, one with such a name itself is a
comment or a teaser unless it is all there is, and the names of classes and ids are not heeded where nothing else is left of a page.

Defined results: null or empty html gives an empty text; unclosed tags end with their parent, and <head> with the
first element or text of a body; a quotation mark that is not closed before an end tag does not begin a value; a page without
weight gives all its lines. Of equal sums the first and the last one count. Repeated rows give repeated results; an empty table an empty one; other
columns are not read. The pass is linear in the length of a page, whatever the page.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: Lines in a sliding window, also the empty lines that part two sections; the sum at which a region surges on any page.
WINDOW, SURGE = 3, 80
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
EMPTY_TAG = re.compile(r"""(?:^|[\s"'])/\Z""")
HIDDEN = re.compile(r"""(?<![\w-])(?:hidden(?:[\s=>]|\Z)|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "textarea", "title", "object", "canvas"}
APART = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "label", "input", "fieldset", "head"} | RAW
SECTION = {"article", "main", "section", "header", "body", "html"}
HOLDERS = {"div", "td", "table", "center", "details"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCK = {"p", "div", "li", "ul", "ol", "dl", "dt", "dd", "table", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "hr", "tbody", "thead", "tfoot", "details", "summary", "center"} | HEADING | SECTION | APART
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
IN_HEAD = {"title", "meta", "link", "style", "script", "base", "noscript", "template"}
#: Names of a class, id or role that mark a part which is not the article: anywhere, and outside an article only.
ANYWHERE = frozenset(
    "ad ads advert adverts advertisement adsbygoogle ad-slot sponsor sponsored promo cookie cookies cookie-notice cookie-banner consent gdpr notice "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments comment-list comments-area reader-comments disqus_thread respond share share-buttons social social-share "
    "related related-posts newsletter subscribe signup login popup modal overlay pagination pager toolbar skip-link complementary contentinfo footer site-footer".split()
)
#: A name of two parts marks as its core does: with a container behind it (promo-box), or a place before it (post-comments).
CORES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo cookie consent comment comments discussion sidebar newsletter subscribe related share social breadcrumb breadcrumbs pagination".split())
CONTAINERS = frozenset("area bar block box button buttons container content form inner items link links list panel row section slot thread unit widget wrap wrapper".split())
PLACES = frozenset("article blog bottom left main page post reader right site story top user visitor".split())
#: Names of an <article> that is not the page's own.
TEASERS = frozenset("teaser teasers card preview".split())
OUTSIDE = ANYWHERE | frozenset("header site-header page-header masthead banner search search-form widget alert dialog page-footer".split())
IMPRINT = re.compile(r"\W*(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\Z")
#: How `read` treats names of classes, ids and roles: they leave parts out, save articles in them, or leave nothing out.
HEED, SPARE, IGNORE = range(3)
#: A start tag of the key ends open elements of the value at the top of the open blocks; any block ends a <p>.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


class Line(NamedTuple):
    text: str
    weight: int
    heading: bool
    inside: bool  # <article> or <main>
    place: int  # the element that holds it


EMPTY = Line("", 0, False, False, 0)


class Page(NamedTuple):
    lines: list[Line]
    parents: list[int]  # of each element, in the order of their start tags; the page itself is 0
    begins: list[int]  # how many lines stand before an element
    ends: list[int]  # and before its end
    holds: list[bool]  # whether it is more than a paragraph


def pieces(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text, is an end tag, tag, attributes) in page order: text has no tag, a tag has no text. Comments and the contents of RAW are left out."""
    at = 0
    loose = False  # whether a search for the end of a tag has met the end of the page
    unclosed: set[str] = set()  # quotation marks and raw elements without a further end
    while (lt := page.find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            yield page[at:lt], False, "", ""
            end = page.find("-->", lt + 2)
            if end < 0:
                return
            at = end + 3
            continue
        declaration = page[lt + 1 : lt + 2] in ("!", "?")
        m = NAME.match(page, lt)
        if not m and not declaration:
            yield page[at : lt + 1], False, "", ""
            at = lt + 1
            continue
        begin = m.end() if m else lt
        first = page.find(">", begin)
        if first < 0:
            break
        yield page[at:lt], False, "", ""
        if not m:
            at = first + 1
            continue
        end = -1 if loose else begin
        while not loose and (stop := STOP.search(page, end)):
            end = stop.start()
            if stop[0] == ">":
                break
            close = -1
            if stop[0] not in unclosed and page[begin:end].rstrip().endswith("="):
                close = page.find(stop[0], end + 1)
                if close < 0:
                    unclosed.add(stop[0])
                elif page.find("</", end, close) >= 0:
                    close = -1
            end = max(close, end) + 1
            begin = end
        else:
            loose, end = True, first
        closing, tag, attributes = bool(m[1]), m[2].lower(), page[m.end() : end]
        at = end + 1
        if not closing and tag in RAW and tag not in unclosed:
            if stop := re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at):
                at = stop.end()
            else:
                unclosed.add(tag)
                if tag in ("script", "style"):
                    return
        if tag not in RAW:
            yield "", closing, tag, attributes
    yield page[at:], False, "", ""


def marked(tag: str, attributes: str, in_article: bool, names: int = HEED) -> bool:
    if tag in APART or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("body", "html", "main"):
        return False
    if tag != "article" and HIDDEN.search(attributes):
        return True
    if names == IGNORE or tag == "article" and names == SPARE:
        return False
    known = ANYWHERE | TEASERS if tag == "article" else ANYWHERE if in_article else OUTSIDE
    return any(x in known or compound(x) for _, a, b, c in ATTRIBUTE.findall(attributes) for x in (a or b or c).lower().split())


def compound(name: str) -> bool:
    """Whether a name of parts marks what its core does."""
    head, *tail = re.split(r"[-_]+", name)
    return bool(tail) and (head in CORES and all(x in CONTAINERS or x in CORES for x in tail) or tail[-1] in CORES and all(x in PLACES for x in (head, *tail[:-1])))


def bare(text: str) -> int:
    """How many letters and digits."""
    return len(re.sub(r"[\W_]+", "", text))


def laid_out(html: str) -> Page:
    page = read(html, HEED)
    if not any(x.inside for x in page.lines) and re.search(r"<(?:article|main)\b", html, re.I):
        spared = read(html, SPARE)
        if any(x.inside for x in spared.lines):
            return spared
    return page if any(x.text for x in page.lines) else read(html, IGNORE)


class Open(NamedTuple):
    tag: str
    out: bool  # left out
    inside: bool
    hidden: bool
    number: int


NONE = Open("", False, False, False, 0)


def read(html: str, names: int) -> Page:
    """The lines of a page. Parts that are not the article are left out."""
    lines: list[Line] = []
    parents, begins, ends, holds = [0], [0], [0], [True]
    stack: list[Open] = []
    where: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
    blocks: list[int] = []  # places of blocks
    hidden = 0
    buffer: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(buffer)).split())
        if text:
            weight = 0 if len(text) <= 120 and IMPRINT.match(text) else max(0, bare(text) - linked) if linked else len(text)
            lines.append(Line(text, weight, any(where[h] for h in HEADING), bool(stack) and stack[-1].inside, stack[-1].number if stack else 0))
        buffer.clear()
        linked = 0

    def part() -> None:
        flush()
        lines.extend([EMPTY] * WINDOW)

    def shut(size: int) -> None:
        """Ends open elements until so many are left."""
        nonlocal hidden
        while len(stack) > size:
            top = stack[-1]
            if top.tag in SECTION or top.out and not (len(stack) > 1 and stack[-2].out):
                if top.out:
                    buffer.clear()
                part()
            elif top.tag in BLOCK and not top.out:
                flush()
            stack.pop()
            ends[top.number] = len(lines)
            where[top.tag].pop()
            hidden -= top.hidden
            if blocks and blocks[-1] == len(stack):
                blocks.pop()

    for text, closing, tag, attributes in pieces(html):
        top = stack[-1] if stack else NONE
        if not tag:
            if top.tag == "head" and text.strip():
                shut(len(stack) - 1)
                top = stack[-1] if stack else NONE
            if not top.out and text:
                buffer.append(text)
                if where["a"]:
                    linked += bare(entities.unescape(text))
            continue
        if closing:
            if where[tag]:
                # an end tag of inline markup does not end blocks around it
                if tag in BLOCK or not blocks or where[tag][-1] > blocks[-1]:
                    shut(where[tag][-1])
            elif tag in BLOCK:
                flush()
            continue
        if top.tag == "head" and tag not in IN_HEAD:
            shut(len(stack) - 1)
            top = stack[-1] if stack else NONE
        if tag in VOID or tag not in BLOCK and EMPTY_TAG.search(attributes):
            if not top.out:
                (flush() if tag == "hr" else buffer.append(" " if tag == "br" else ""))
            continue
        if tag in BLOCK:
            while blocks and (stack[blocks[-1]].tag == "p" or stack[blocks[-1]].tag in CLOSES.get(tag, ())):
                shut(blocks[-1])
            top = stack[-1] if stack else NONE
        out = top.out and not (names == SPARE and not top.inside and tag in ("article", "main") and not hidden)
        leave = out or marked(tag, attributes, top.inside, names)
        if not out:
            if tag in SECTION or leave:
                part()
            elif tag in BLOCK:
                flush()
        where[tag].append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append(Open(tag, leave, top.inside or tag in ("article", "main"), bool(HIDDEN.search(attributes)), len(parents)))
        parents.append(top.number)
        begins.append(len(lines))
        ends.append(-1)
        holds.append(tag in SECTION or tag in HOLDERS)
        hidden += stack[-1].hidden
    if not (stack and stack[-1].out):
        flush()
    for top in (NONE, *stack):
        ends[top.number] = len(lines)
    return Page(lines, parents, begins, ends, holds)


def main_text(html: str) -> str:
    return "\n".join(x.text for x in between(laid_out(html)) if x.text)


def weights_of(lines: list[Line]) -> np.ndarray:
    """What the lines weigh, by what the page says of its article."""
    own = np.array([x.weight for x in lines], dtype=np.int64)
    inside = np.array([bool(x.text) and x.inside for x in lines], dtype=bool)
    return np.where(inside, own + SURGE, 0) if inside.any() else own


def held_by(page: Page, first: int, last: int) -> tuple[int, int]:
    """The lines of the innermost element that holds both lines."""
    a, b = page.lines[first].place, page.lines[last].place
    while a != b:  # an element stands after its parent
        a, b = (page.parents[a], b) if a > b else (a, page.parents[b])
    while not page.holds[a]:
        a = page.parents[a]
    return page.begins[a], page.ends[a]


def between(page: Page) -> list[Line]:
    """What stands between the first surge and the last dive, and the regions beside it that belong to it."""
    lines = page.lines
    weights = weights_of(lines)
    if not weights.any():
        return lines
    sums = np.convolve(weights, np.ones(WINDOW, dtype=np.int64))[: len(lines)]  # of a line and those before it
    alive = np.concatenate([[False], sums > 0, [False]])
    begins, dives = (np.flatnonzero(x) for x in (~alive[:-1] & alive[1:], alive[:-1] & ~alive[1:]))
    surging = np.flatnonzero(np.maximum.reduceat(sums, begins) >= min(SURGE, sums.max() / 2))
    first, last = surging[0], surging[-1]
    regions = [a + np.flatnonzero(weights[a:b])[[0, -1]] for a, b in zip(begins, dives, strict=True)]
    low, high = held_by(page, regions[first][0], regions[last][1])
    kept: list[Line] = []
    for k, (a, b) in enumerate(regions):
        region = lines[a : b + 1]
        title = k < first and any(x.heading for x in region)
        if first <= k <= last or title or low <= a and b < high and any(x.heading or SENTENCE.search(x.text) for x in region):
            kept += region
    return kept


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
