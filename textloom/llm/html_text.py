"""Main text of HTML pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering.

The standard library's parser streams a page's events. A block element starts and ends lines; a line has its
text, the number of tags that stood in it, how much of it is links, and the block it is in. Ratios of text to tags of all
lines are smoothed along the page with a Gaussian, and lines are clustered by a threshold, the standard deviation
of the smoothed ratios: those at or above it are content, the others are not.

The clusters choose the region. From the page down, the block with most content characters is entered if it holds
the page's heading and HEADED of its parent's content, or SHARE of it where there is no heading, and is no part of a list,
table or quotation. An article or main element with HEADED of the content is entered without a heading and is the last.
All lines of a region stay, but for what names say is not the article and for lists of links beside it. If the content fills
no block of its own and the region is the page's body, those of its lines stay that are content, or stand in a part of it (a
child) that has some, or between such parts, or in headings just before the first or paragraphs just after the last.

Names only help. Blocks that are not the article's own by element or by their class, id or role (NOT_ARTICLE: a name that
consists of such words, with words of layout beside them) go with all their lines: menus, headers, footers, asides,
adverts, notices, comments, forms. So do inline adverts, what is hidden, scripts and styles, and an article inside an
article that has less than half of the content; articles side by side are parts of one.

Elements whose end tag may be left out (p, li, dt, dd, tr, td, th) end where HTML ends them; an element without
text of its own (canvas, svg, ...) that never ends hides nothing, and a button inside a paragraph is part of it.
The work is linear in the page, however deep it nests.

A null, an empty or a tagless page is handled like any other: without a line the text is empty. Malformed
markup never raises. Rows are independent, so repeated ones give equal results; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from . import _words as W

RADIUS, SIGMA, SHARE, HEADED = 2, 1.0, 0.7, 0.5
#: Element names of HTML, and words that name what is not an article.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select button textarea datalist".split())
FOREIGN = frozenset("nav footer aside form dialog menu".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split())
HOLDS = BLOCK | {"td", "th"}
PARTS = frozenset("blockquote dd details dl dt figure header li ol p pre table tbody td tfoot th thead tr ul".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br td th img input".split())
#: What a start tag ends, and what keeps it from being ended. A p ends before any block.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody")}
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",)}
NOT_ARTICLE = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments
consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal more nav navbar navigation newsletter notice notices overlay
pagination pager paywall popup promo promoted promotion reactions recommended related replies reply respond share sharing sidebar signup skip social
sponsor sponsored subscribe subscription tags teaser teasers toolbar widget widgets alert complementary contentinfo""".split())
ADVERT = frozenset("ad ads advert adverts advertisement advertising promo promoted promotion sponsor sponsored".split())
LAYOUT = frozenset("""area bar block body bottom box button buttons container content entry footer form global group head holder inline inner item left
link links list main message outer page panel post posts primary right row secondary section site slot text this top unit wrap wrapper""".split())
_GAUSS = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]
_CLOSING = re.compile("</(" + "|".join(sorted(SILENT)) + r")(?=[\s/>])", re.IGNORECASE)


def _names(attrs: list, words: frozenset) -> bool:
    """Whether a class, id, role or label consists of ``words``, with words of layout and numbers beside them."""
    for name, value in attrs:
        if value and name in ("class", "id", "role", "aria-label"):
            for token in [value] if name == "aria-label" else value.split():
                said = [x for x in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if x]
                if any(x in words for x in said) and all(x in words or x in LAYOUT for x in said):
                    return True
    return False


def _hidden(attrs: list) -> bool:
    return any(n == "hidden" or (n == "style" and v and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v.lower())) for n, v in attrs)


class _Lines(HTMLParser):
    """Lines of a page: (text, tags, characters of links, block); blocks: [parent, name, mark, has the page's heading], the page first."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.nodes: list[list] = [[-1, "", 0, False]]
        self.open = [0]
        self.at: dict[str, list[int]] = defaultdict(list)  # where the open blocks of a name stand in ``open``
        self.silent: list[str] = []
        self.muted: list = ["", 0]  # an inline element that is no text, and how deep it nests in itself
        self.pieces: list[str] = []
        self.tags = self.links = self.linked = 0
        self.starts = [0, *(m.end() for m in re.finditer("\n", html))]
        self.last = {m[1].lower(): m.start() for m in _CLOSING.finditer(html)}

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.open[-1]))
        self.pieces, self.tags, self.linked = [], 0, 0

    def place(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def close_from(self, k: int) -> None:
        """End the open blocks from the k-th on; one that is marked has its text to itself."""
        if any(self.nodes[node][2] for node in self.open[k:]):
            self.flush()
        for node in reversed(self.open[k:]):
            self.at[self.nodes[node][1]].pop()
        del self.open[k:]

    def end(self, names: tuple[str, ...], fences: tuple[str, ...] = ()) -> None:
        """End the innermost open blocks of ``names`` that stand inside all ``fences``."""
        fence = max((self.at[f][-1] for f in fences if self.at[f]), default=0)
        k = min((x for n in names for x in self.at[n][bisect_right(self.at[n], fence):][:1]), default=None)
        if k is not None:
            self.close_from(k)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent:
            if tag != "body":
                return
            self.silent = []  # a head that was never closed
        if tag in SILENT:
            inline = tag == "button" and self.at["p"] and self.open[-1] == self.open[self.at["p"][-1]]
            if not inline and self.last.get(tag, -1) > self.place():
                if tag in ("head", "title", "template"):
                    self.flush()
                self.silent.append(tag)
            return
        if tag in BLOCK:
            self.flush()
            self.muted = ["", 0]
            if self.at["p"]:
                self.end(("p",), ("td", "th", "li", "div", "article", "section", "main"))
        elif tag in SPACED:
            self.pieces.append(" ")
        if self.muted[1]:
            self.muted[1] += tag == self.muted[0] and tag not in VOID
        elif tag not in HOLDS and tag not in VOID and (_hidden(attrs) or _names(attrs, ADVERT)):
            self.muted = [tag, 1]
        if tag in ENDS:
            self.end(ENDS[tag], FENCES[tag])
        self.tags += 1
        self.links += tag == "a"
        if tag in HOLDS and tag not in VOID:
            mark = 0
            if tag in FOREIGN or (tag == "header" and not self.at["article"] and not self.at["main"]) or (tag not in ("html", "body") and _hidden(attrs)):
                mark = 2
            elif tag not in ("html", "body", "main") and _names(attrs, NOT_ARTICLE):
                mark = 1
            if mark:
                self.flush()
            self.nodes.append([self.open[-1], tag, mark, tag in ("h1", "main")])
            self.at[tag].append(len(self.open))
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID or tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
            return
        if tag in SILENT:
            return
        if tag in BLOCK:
            self.flush()
            self.muted = ["", 0]
        elif tag in SPACED:
            self.pieces.append(" ")
        if self.muted[1] and tag == self.muted[0]:
            self.muted[1] -= 1
        self.tags += 1
        self.links -= tag == "a" and self.links > 0
        if self.at[tag]:
            self.close_from(self.at[tag][-1])

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """One of an unknown kind is a comment up to its next ``>``."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, 0)

    def handle_data(self, data: str) -> None:
        if not self.silent and not self.muted[1]:
            self.pieces.append(data)
            if self.links:
                self.linked += len("".join(data.split()))


def _parsed(html: str) -> _Lines:
    # zeros go, and numbers beyond all characters become the first such: int() raises at thousands of digits
    html = re.sub(r"&#(?=[0-9]{8})0*([0-9]+)", lambda m: f"&#{m[1] if len(m[1]) < 8 else 0x110000}", html)
    p = _Lines(html)
    p.feed(html)
    p.close()
    p.flush()
    return p


def smoothed(ratios: list[float]) -> list[float]:
    """Each ratio averaged with its neighbours under a Gaussian; at the ends the weights there are renormed."""
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for d in range(-RADIUS, RADIUS + 1):
            if 0 <= i + d < len(ratios):
                total += _GAUSS[d + RADIUS] * ratios[i + d]
                weight += _GAUSS[d + RADIUS]
        out.append(total / weight)
    return out


def clustered(ratios: list[float]) -> list[bool]:
    """Which lines are content: smoothed ratios at or above their standard deviation."""
    s = smoothed(ratios)
    mean = sum(s) / len(s)
    threshold = math.sqrt(sum((x - mean) ** 2 for x in s) / len(s))
    return [x >= threshold for x in s]


def extract(html: str | None) -> str:
    """The main text of one page: its blocks, joined by empty lines."""
    if not html:
        return ""
    p = _parsed(html)
    if not p.lines:
        return ""
    nodes, n = p.nodes, len(p.nodes)
    for k in range(n - 1, 0, -1):  # a block's number is larger than that of the one it is in
        if nodes[k][3]:
            nodes[nodes[k][0]][3] = True
    # an element whose class says header but that holds the page's heading or main part is a wrapper
    foreign = [False] * n
    for k, (parent, tag, mark, holds) in enumerate(nodes):
        foreign[k] = (parent >= 0 and foreign[parent]) or mark == 2 or (mark == 1 and (not holds or tag == "h1"))
    content = clustered([len(t) / max(1, tags) for t, tags, _, _ in p.lines])
    lines = [(x, yes) for x, yes in zip(p.lines, content, strict=True) if not foreign[x[3]]]
    chars = [0] * n
    for (t, _, _, node), yes in lines:
        chars[node] += len(t) if yes else 0
    heading = [False] * n
    for k in range(n - 1, 0, -1):
        heading[k] = heading[k] or (nodes[k][1] == "h1" and not foreign[k])
        heading[nodes[k][0]] |= heading[k]
        chars[nodes[k][0]] += chars[k]
    region = _region(nodes, chars, heading)
    named = nodes[region][1] in ("article", "main")
    article = nodes[region][1] == "article"
    inside = [False] * n
    for k in range(1, n) if region else range(n):
        beside = article and nodes[k][1] == "article" and nodes[k][0] == nodes[region][0] and chars[k] > 0  # an article in several parts
        inside[k] = k == region or beside or (nodes[k][0] >= 0 and inside[nodes[k][0]])
        if article and inside[k] and nodes[k][1] == "article" and not beside and 2 * chars[k] < chars[region]:
            inside[k] = False  # what answers the article or points to others
    lines = [(x, yes) for x, yes in lines if inside[x[3]]]
    return "\n\n".join(x[0] for x, _ in lines) if named else "\n\n".join(_selected(nodes, lines, region))


def _region(nodes: list[list], chars: list[int], heading: list[bool]) -> int:
    """The block that the content fills."""
    most = [-1] * len(nodes)
    for k in range(1, len(nodes)):
        if chars[k] > 0 and (most[nodes[k][0]] < 0 or chars[k] > chars[most[nodes[k][0]]]):
            most[nodes[k][0]] = k
    k = 0
    while most[k] >= 0 and nodes[k][1] not in ("article", "main"):
        child = most[k]
        whole = nodes[child][1] in ("html", "body")
        named = nodes[child][1] in ("article", "main") and chars[child] >= HEADED * chars[k]
        alone = heading[child] and chars[child] >= HEADED * chars[k] or not heading[k] and chars[child] >= SHARE * chars[k]
        if nodes[child][1] in PARTS | HEADS or not (whole or named or alone):
            break
        k = child
    return k


def _selected(nodes: list[list], lines: list[tuple[tuple[str, int, int, int], bool]], region: int) -> list[str]:
    """The lines of a region that has no name."""
    part = [-1] * len(nodes)  # the child of the region that each block is in
    for k, (parent, *_) in enumerate(nodes[1:], 1):
        part[k] = k if parent == region else part[parent]
    group = lambda i: part[lines[i][0][3]] if part[lines[i][0][3]] >= 0 else -2 - i
    kind = lambda i: nodes[part[lines[i][0][3]]][1] if part[lines[i][0][3]] >= 0 else ""
    has: dict[int, bool] = defaultdict(bool)
    text: dict[int, int] = defaultdict(int)
    linked: dict[int, int] = defaultdict(int)
    for i, (x, yes) in enumerate(lines):
        has[group(i)] |= yes
        text[group(i)] += len("".join(x[0].split()))
        linked[group(i)] += x[2]
    own = nodes[region][1] not in ("", "html", "body")
    kept = [i for i in range(len(lines)) if 2 * linked[group(i)] <= text[group(i)] or own and (kind(i) == "p" or kind(i) in HEADS)]
    if own:
        return [lines[i][0][0] for i in kept]
    held = [k for k, i in enumerate(kept) if has[group(i)]]
    if not held:
        return []
    first, last = held[0], held[-1]
    while first > 0 and (kind(kept[first - 1]) in HEADS or part[lines[kept[first - 1]][0][3]] >= 0 and nodes[part[lines[kept[first - 1]][0][3]]][3]):
        first -= 1
    while last + 1 < len(kept) and kind(kept[last + 1]) == "p":
        last += 1
    return [lines[i][0][0] for i in kept[first : last + 1]]


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.small(batches):
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    d = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return d.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op10_html_extraction": op10}
