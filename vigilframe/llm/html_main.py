"""Main text of web pages: parser events, text-to-tag ratios by line, smoothing, and threshold clusters.

The standard library's parser gives events. They make lines, one for each block of text, with the characters of text
outside and inside of links and the tags that were met. A line's ratio is text outside links over tags. Ratios are
smoothed by a Gaussian along the page, and the lines above a threshold form clusters. The content regions are the article
and main elements if they have most of the clusters' text, else the deepest container that holds all clusters; all their
lines belong to the main text, but those in menus, notices and the like, which are left out.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Callable
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vigilframe.llm.common import per_text

# Fixed values of HTML: elements without content, elements that end lines, elements that are never main text,
# and elements that can hold an article.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HIDDEN = {"head", "title", "script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "button", "datalist"}
APART = {"nav", "aside", "footer", "form", "menu", "dialog"}
CONTAINERS = {"html", "body", "article", "main", "section", "div", "table", "tbody", "tr", "td", "center", "blockquote"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Choices of this operator: elements whose class, id and role can name a part beside the article, the words that do, those of
# them that name readers' comments, and words that name the article's own parts.
NAMED = {"div", "section", "ul", "ol", "dl", "table", "td", "header", "center", "span", "details", "figure", "fieldset"}
COMMENTS = {"comment", "comments", "disqus", "replies", "respond", "reviews"}
BESIDE = COMMENTS | {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "alertdialog", "banner", "breadcrumb", "breadcrumbs", "complementary", "consent", "contentinfo", "cookie", "cookies",
    "copyright", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "outbrain", "pager", "pagination", "popup", "promo", "promoted",
    "related", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "taboola", "toolbar", "topbar", "widget",
}
OWN = {"article", "post", "entry", "story", "content"}
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
SIGMA = 2.0
#: lines that a part with a name of the kind must have to count as a wrapper of the page
WRAPPED = 4


class Line:
    __slots__ = ("parts", "linked", "tags", "container", "part", "text")

    def __init__(self, container: int, part: int) -> None:
        self.parts: list[str] = []
        self.linked, self.tags, self.container, self.part, self.text = 0, 0, container, part, ""

    def ratio(self) -> float:
        return max(0, len(self.text) - self.linked) / max(1, self.tags)


@functools.lru_cache(4096)
def _words(values: tuple[str, ...]) -> frozenset[str]:
    return frozenset(w for v in values for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower()))


class Part:
    """A part of the page that may be beside the article. sure: told by its element, or readers' comments; own: of an article by
    its place or name; titled: holds a main heading."""

    __slots__ = ("parent", "sure", "own", "titled", "mass", "lines")

    def __init__(self, parent: int, sure: bool, own: bool) -> None:
        self.parent, self.sure, self.own, self.titled, self.mass, self.lines = parent, sure, own, False, 0, 0


class LineParser(HTMLParser):
    """Turns events into lines. Each open element: tag, number of its container, whether hidden, number of its part, whether in
    an article. Every event costs the elements that it opens or closes, whatever the depth is."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, bool, int, bool]] = [("", 0, False, 0, False)]
        self.held: dict[str, int] = defaultdict(int)
        self.parents, self.kinds = [-1], [""]
        self.page_parts = [Part(-1, False, False)]
        self.line = Line(0, 0)

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers aren't needed."""
        return j

    def end_line(self) -> None:
        line = self.line
        _, container, _, part, _ = self.open[-1]
        if line.parts:
            line.text = " ".join("".join(line.parts).split())
            if line.text:
                self.lines.append(line)
            self.line = Line(container, part)
        else:
            line.container, line.part = container, part

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            if tag == "hr":
                self.end_line()
            self.line.tags += 1
            return
        if tag in BLOCKS and any(t == "p" for t, *_ in self.open[-3:]):
            self._close("p", {"p"})
        if tag in CLOSES:
            for inner in CLOSES[tag]:
                self._close(inner, {"ul", "ol", "table", "dl", "select"})
        _, container, hidden, part, inside = self.open[-1]
        words = _words(tuple(v for k, v in attrs if v and k in ("class", "id", "role"))) if attrs else frozenset()
        gone = hidden or tag in HIDDEN or any(k == "hidden" or (k == "aria-hidden" and (v or "").lower() == "true") or (k == "style" and v and INVISIBLE.search(v)) for k, v in attrs)
        sure = tag in APART or (tag == "header" and not inside) or (tag in NAMED and bool(words & COMMENTS))
        before = part
        if sure or (tag in NAMED and words & BESIDE):
            part = len(self.page_parts)
            self.page_parts.append(Part(before, sure, inside or bool(words & OWN)))
        main = tag in ("article", "main") or (tag == "div" and "main" in words)
        if tag in CONTAINERS:
            self.parents.append(container)
            self.kinds.append("main" if main and tag == "div" else tag)
            container = len(self.parents) - 1
        if tag == "h1":
            self.page_parts[part].titled = True
        self._push((tag, container, gone, part, inside or main))
        if tag in BLOCKS or part != before:
            self.end_line()
        self.line.tags += 1

    def _push(self, element: tuple[str, int, bool, int, bool]) -> None:
        self.open.append(element)
        self.held[element[0]] += 1

    def _pop(self, k: int) -> None:
        for tag, *_ in self.open[k:]:
            self.held[tag] -= 1
        del self.open[k:]

    def _close(self, tag: str, border: set[str]) -> None:
        """Close the nearest open tag unless a border element is between."""
        if not self.held[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self._pop(k)
                self.end_line()
                return
            if self.open[k][0] in border or (tag == "p" and self.open[k][0] in CONTAINERS):
                return

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        if not self.held[tag]:
            return
        inline = tag not in BLOCKS
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                was = self.open[-1][3]
                self._pop(k)
                if not inline or was != self.open[-1][3]:
                    self.end_line()
                return
            if inline and self.open[k][0] in BLOCKS:
                return  # an inline end tag closes no block

    def handle_data(self, data: str) -> None:
        if self.open[-1][2]:
            return
        self.line.parts.append(data)
        if self.held["a"]:
            self.line.linked += len("".join(data.split()))

    def beside(self) -> list[bool]:
        """Which parts are left out: those told by their element, readers' comments, and those that only a class, an id or a role
        names, unless they hold most of the text in a title or several lines, or the title of an article that they belong to."""
        parts, sure = self.page_parts, [False]
        for part in parts[1:]:
            sure.append(part.sure or sure[part.parent])
        total = 0
        for line in self.lines:
            mass = max(0, len(line.text) - line.linked)
            parts[line.part].mass += mass
            parts[line.part].lines += 1
            total += 0 if sure[line.part] else mass
        for k in range(len(parts) - 1, 0, -1):
            part, above = parts[k], parts[parts[k].parent]
            if not part.sure:
                above.mass, above.lines, above.titled = above.mass + part.mass, above.lines + part.lines, above.titled or part.titled
        out = [False]
        for part in parts[1:]:
            most = part.mass * 2 > total and (part.titled or part.lines >= WRAPPED)
            out.append(out[part.parent] or part.sure or not (most or part.titled and part.own))
        return out


def smooth(values: list[float], sigma: float = SIGMA) -> np.ndarray:
    """Gaussian means; at the ends the weights inside the page are scaled to one."""
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    inside = lambda x: np.convolve(x, kernel)[reach : reach + len(values)]
    return inside(np.asarray(values, float)) / inside(np.ones(len(values)))


def clusters(ratios: list[float]) -> list[tuple[int, int]]:
    """Runs [start, end) of lines with a smoothed ratio of at least half the mean of all lines that have text outside links."""
    if not any(ratios):
        return []
    level = smooth(ratios)
    positive = [r for r in ratios if r > 0]
    threshold = min(sum(positive) / len(positive) / 2, float(level.max()))
    runs, start = [], None
    for i, v in enumerate([*level.tolist(), -1.0]):
        if v >= threshold and start is None:
            start = i
        elif v < threshold and start is not None:
            runs.append((start, i))
            start = None
    return runs


def grown(ratios: list[float], runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs, each with the lines before and after it up to one without text outside links: titles, leads, short ends.
    Runs that grow together become one."""
    out: list[tuple[int, int]] = []
    for lo, hi in runs:
        while lo > 0 and ratios[lo - 1] > 0:
            lo -= 1
        while hi < len(ratios) and ratios[hi] > 0:
            hi += 1
        if out and lo <= out[-1][1]:
            lo, hi = min(lo, out[-1][0]), max(hi, out.pop()[1])
        out.append((lo, hi))
    return out


def _mass(parser: LineParser, lines: list[Line], ratios: list[float], runs: list[tuple[int, int]]) -> list[int]:
    """Characters of the runs' lines with text outside links, in each container. A container's number is above its parent's."""
    mass = [0] * len(parser.parents)
    for lo, hi in runs:
        for line, ratio in zip(lines[lo:hi], ratios[lo:hi], strict=True):
            if ratio > 0:
                mass[line.container] += len(line.text)
    for c in range(len(mass) - 1, 0, -1):
        mass[parser.parents[c]] += mass[c]
    return mass


def main_blocks(html: str) -> list[str]:
    parser = LineParser()
    tail = html.rfind(">") + 1  # no tag ends after it: a "<" there is text, and would be tried as a tag to the end each time
    parser.feed(html[:tail] + html[tail:].replace("<", "&lt;"))
    parser.close()
    parser.end_line()
    left_out = parser.beside()
    lines = [line for line in parser.lines if not left_out[line.part]]
    ratios = [line.ratio() for line in lines]
    runs = clusters(ratios)
    mass = _mass(parser, lines, ratios, runs)
    if not mass[0]:
        return []
    # article and main elements that have text of the clusters, each with all that is in it; the outermost count
    marked, above = [False] * len(mass), [False] * len(mass)
    for c in range(1, len(mass)):
        above[c] = above[parser.parents[c]] or marked[parser.parents[c]]
        marked[c] = mass[c] > 0 and parser.kinds[c] in ("article", "main")
    regions = {c for c in range(len(mass)) if marked[c] and not above[c]}
    if sum(mass[c] for c in regions) * 2 <= mass[0]:
        # else the deepest container that holds all clusters, and the lines next to them that have text outside links
        mass = _mass(parser, lines, ratios, grown(ratios, runs))
        regions = {max(c for c in range(len(mass)) if mass[c] == mass[0])}
    inside = [0 in regions] * len(mass)
    for c in range(1, len(mass)):
        inside[c] = c in regions or inside[parser.parents[c]]
    return [line.text for line in lines if inside[line.container]]


def main_text(html: str) -> str:
    return "\n\n".join(main_blocks(html))


def extract(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """keys, text and n_chars (code points) for each page. Null or empty html, and pages without text outside menus
    and the like, have an empty text. Repeated rows stay; other columns are ignored, whatever their names; empty input gives an
    empty result. A page's time follows its length, however deep its elements are."""

    def make() -> Callable[[bytes | None], tuple]:
        def one(raw: bytes | None) -> tuple:
            text = main_text((raw or b"").decode())
            return text, len(text)

        return one

    return per_text(pages, keys, html, [("text", T.StringType()), ("n_chars", T.LongType())], make)
