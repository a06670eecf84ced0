"""Main text of web pages by composite text density of DOM nodes."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "option", "tbody", "tfoot", "thead", "tr"}
NEVER = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe map math menu nav noembed noframes noscript object script "
    "select style svg template textarea title video".split()
)
SAME = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
    "tbody": (("tbody", "thead", "tfoot", "tr"), ("table",)), "thead": (("tbody", "thead", "tfoot", "tr"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr"), ("table",)),
}
"""For a start tag: the open elements that it closes, and those that shield outer ones."""

OPENING = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)", re.S)
MARK = re.compile("[>\"']")
HINT = re.compile(r"(?<![\w-])(class|id|role|aria-hidden|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I | re.S)
# Words of class and id names that set an element aside, and those that may stand beside them in such a name.
ASIDE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promos promotion nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidenav footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription share sharing social comment comments commentlist disqus replies respond widget widgets login signup searchform paywall "
    "pagination pager toolbar skiplink".split()
)
BOXES = ASIDE | frozenset("discussion responses related recommended rail adsbygoogle cookiebar bio".split())
"""With names that set a box aside, but no single paragraph or heading."""
BESIDE = frozenset(
    "area article author bar blog body bottom box block buttons col column container content form global group holder icons inner item items left line link links list "
    "main message mobile outer page panel post posts primary reader right row section secondary site slot text thread title top unit user wrap wrapper zone".split()
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())


class Node:
    """One element: its children in order (nodes and decoded text), and the counts that densities need."""

    __slots__ = ("tag", "parent", "parts", "away", "chars", "tags", "link_chars", "link_tags", "density", "total", "plain", "holds", "soft", "titled")

    def __init__(self, tag: str, parent: Node | None, away: bool):
        self.tag, self.parent, self.away = tag, parent, away
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.plain = self.holds = self.soft = False
        self.titled = tag == "h1"


def _named_aside(value: str, names: frozenset[str] = ASIDE) -> bool:
    """Whether a class or id attribute names something set aside: one of its names has such a word and otherwise only words that tell where or how it stands."""
    for name in value.lower().split():
        words = [w for w in re.split(r"[-_]+", name.replace("side-bar", "sidebar").replace("skip-link", "skiplink").replace("search-form", "searchform")) if w and not re.fullmatch("[0-9]+(x[0-9]+)?", w)]
        if any(w in names for w in words) and all(w in names or w in BESIDE for w in words):
            return True
    return False


def _set_aside(tag: str, attributes: str, inside_article: bool) -> bool:
    """Whether an element is no part of an article by its name, role, or class and id words."""
    if tag in NEVER or tag == "header" and not inside_article:
        return True
    if not attributes:
        return False
    for m in HINT.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower().strip() in AWAY_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id") and tag not in ("body", "html", "article", "main") and _named_aside(value, ASIDE if tag in ("p", *HEADINGS) else BOXES):
            return True
    return False


def _page_header(attributes: str) -> bool:
    """Whether a class or id names a header; it is set aside outside articles unless it holds the page's first heading."""
    return any(re.search(r"(?:^|\s)(?:(?:site|page|top|global|main)[-_])?header(?:[-_](?:bar|inner|wrap|wrapper|container))?(?:$|\s)", m[2] or m[3] or m[4] or "", re.I) for m in HINT.finditer(attributes) if m[1].lower() in ("class", "id"))


class Tags:
    """The tags, comments and doctypes of a page, each found by going forward once.

    A quoted value ends at its next quote; a quote that nothing closes is a character like others. Where a tag finds no end behind quoted
    values, they are broken: it and all later tags end at the next ``>``, so no part of a page is scanned more than twice.
    """

    def __init__(self, page: str):
        self.page, self.quoted = page, True
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def end(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` has its ``>``; -1 for none."""
        begun = at
        while m := MARK.search(self.page, at):
            if m[0] == ">":
                return m.start()
            at = self.page.index(m[0], m.end()) + 1 if self.quoted and m.start() < self.last[m[0]] else m.end()
        self.quoted = False
        return self.page.find(">", begun)

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """``(start, end, closing, name, attributes)`` of the first one from ``at``; names of comments and doctypes are empty."""
        while m := OPENING.search(self.page, at):
            if not m[2]:
                return m.start(), m.end(), False, "", ""
            if m.end() <= self.last[">"] and (stop := self.end(m.end())) >= 0:
                return m.start(), stop + 1, bool(m[1]), m[2].lower(), self.page[m.end() : stop]
            at = m.end()
        return None


class Open:
    """The elements that are open, with the places of each name."""

    def __init__(self, root: Node):
        self.root, self.stack, self.where, self.blocks, self.articles = root, [], {}, [], 0

    def here(self) -> Node:
        return self.stack[-1] if self.stack else self.root

    def push(self, node: Node) -> None:
        self.where.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK and node.tag != "p":
            self.blocks.append(len(self.stack))
        self.articles += node.tag in ("article", "main")
        self.stack.append(node)

    def close(self, place: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.stack) > place:
            node = self.stack.pop()
            self.where[node.tag].pop()
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()
            self.articles -= node.tag in ("article", "main")

    def begun(self, tag: str) -> None:
        """Close what a start tag closes: the outermost element of its kind that nothing shields, or a paragraph in the same block."""
        closes, shields = SAME.get(tag, ((), ()))
        if closes:
            shield = max((self.where[s][-1] for s in shields if self.where.get(s)), default=-1)
        elif tag in CLOSES_P:
            closes, shield = ("p",), self.blocks[-1] if self.blocks else -1
        else:
            return
        places = [held[i] for c in closes if (held := self.where.get(c)) and (i := bisect_right(held, shield)) < len(held)]
        if places:
            self.close(min(places))


def parse(page: str) -> Node:
    """A DOM of ``page`` that forgives missing end tags; comments, doctypes and raw-text elements carry no text."""
    root = Node("#root", None, False)
    tags, opened, at = Tags(page), Open(root), 0
    while True:
        m = tags.next(at)
        here = opened.here()
        text = page[at : m[0]] if m else page[at:]
        if text and not text.isspace():
            here.parts.append(html.unescape(text))
        elif text:
            here.parts.append(" ")
        if not m:
            return root
        _, at, closing, tag, attributes = m
        if not tag:
            continue
        if closing:
            if held := opened.where.get(tag):
                opened.close(held[-1])
            continue
        opened.begun(tag)
        here = opened.here()
        node = Node(tag, here, _set_aside(tag, attributes, opened.articles > 0))
        node.soft = not opened.articles and bool(attributes) and tag not in ("body", "html", "article", "main") and _page_header(attributes)
        here.parts.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = page.find(">", end.start()) + 1 if end else len(page)
            at = at or len(page)
            continue
        opened.push(node)


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """Characters per tag, scaled by a logarithm that falls with the share of link text and link tags beside that of the whole body."""
    links = max(link_chars, 1)
    foot = math.log(chars * links / max(chars - link_chars, 1) + body_share * chars + math.e)
    lift = math.log(max(chars / links * max(tags, 1) / max(link_tags, 1), 1.0) + 1.0)
    return chars / max(tags, 1) * lift / math.log(foot + 1.0)


def measure(root: Node) -> tuple[list[Node], float]:
    """Fill in counts, densities and density sums bottom-up; returns the elements in page order and the body's share of link text."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    for node in reversed(order):
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len(part.strip())
                node.plain = node.plain or any(c.isalnum() for c in part)
            else:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.chars if part.tag == "a" else part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
                node.plain = node.plain or part.tag != "a" and part.plain
                node.titled = node.titled or part.titled
    base = next((n for n in order if n.tag == "body"), root)
    body_share = base.link_chars / base.chars if base.chars else 0.0
    for node in reversed(order):
        if node.chars:
            node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, body_share)
        node.total = sum(p.density for p in node.parts if isinstance(p, Node))
    return order, body_share


def least_density(node: Node) -> float:
    """The least density on the path from a node to the body, or to the top of a page without one."""
    path = [node]
    while path[-1].parent is not None and path[-1].tag != "body":
        path.append(path[-1].parent)
    return min(n.density for n in path)


def choose(root: Node) -> tuple[Node, Node | None] | None:
    """The node whose children's densities have the greatest sum, widened to all of the article, and the node that is article throughout.

    That is the article or main element that holds it. Without one it is the lowest element that also holds all
    other blocks and loose texts at least as dense as the least on the path from the node to the body,
    and the heading before them. Elements set aside, and all inside them, take no part. Article throughout is the marked
    element, else the node of greatest sum, unless that is the whole body, which may hold menus of no such name.
    """
    best = None
    order, body_share = measure(root)
    for node in order:
        node.away = node.away or node.soft and not node.titled or (node.parent is not None and node.parent.away)
        if not node.away and node.chars and (best is None or node.total > best.total):
            best = node
    if best is None:
        return None
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    marked = [n for n in path if n.tag in ("article", "main")]
    if marked:
        return marked[-1], marked[-1]
    return _with_heading(_with_dense(best, order, body_share), order), None if best.tag in ("body", "html", "#root") else best


def _with_dense(best: Node, order: list[Node], body_share: float) -> Node:
    """The lowest element that holds ``best`` and all other dense text of the page."""
    threshold = least_density(best)
    for node in reversed(order):
        if node.away:
            continue
        dense = node.tag in BLOCK and node.plain and node.density >= threshold
        for part in node.parts:
            if isinstance(part, Node):
                dense = dense or part.holds
            elif not dense and node.tag != "a" and (n := len(part.strip())):
                dense = density(n, 0, 0, 0, body_share) >= threshold
        node.holds = dense
    top, node = best, best
    while node.parent is not None:
        below, node = node, node.parent
        loose = any(isinstance(p, str) and (n := len(p.strip())) and density(n, 0, 0, 0, body_share) >= threshold for p in node.parts)
        if loose or any(isinstance(p, Node) and p is not below and p.holds for p in node.parts):
            top = node
    return top


def _with_heading(top: Node, order: list[Node]) -> Node:
    """``top``, or the lowest element that also holds the last of the highest headings before it, if that is higher than all in it."""
    inside = {id(top)}
    found, start = None, False
    own = len(HEADINGS)
    for node in order:
        start = start or node is top
        if node.parent is not None and id(node.parent) in inside:
            inside.add(id(node))
        if node.away or not node.chars or node.tag not in HEADINGS:
            continue
        level = HEADINGS.index(node.tag)
        if id(node) in inside:
            own = min(own, level)
        elif not start and (found is None or level <= HEADINGS.index(found.tag)):
            found = node
    if found is None or HEADINGS.index(found.tag) >= own:
        return top
    above = set()
    node = found
    while node is not None:
        above.add(id(node))
        node = node.parent
    while id(top) not in above:
        top = top.parent
    return top


def blocks(top: Node, core: Node | None) -> list[str]:
    """The text blocks of the chosen subtree in page order, blanks collapsed.

    Inside ``core`` nothing is left out but elements set aside. Elsewhere a list or box that is wholly links and less dense than
    the least dense node on the path from the chosen node to the body is navigation and left out too.
    """
    threshold = least_density(top)
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    stack: list[tuple[Node | str | None, bool]] = [(top, top is core)]
    while stack:
        part, inside = stack.pop()
        if part is None:
            close()
            continue
        if isinstance(part, str):
            run.append(part)
            continue
        inner = [(p, inside or p is core) for p in reversed(part.parts)]
        if part.tag == "br" or part.tag in ("td", "th"):
            run.append(" ")
            stack.extend(inner)
        elif not part.away:
            linked = part.link_tags > 1 and not part.plain and part.density < threshold
            if linked and not inside and part is not top and part.tag in ("ul", "ol", "div", "section", "table"):
                close()
                continue
            if part.tag in BLOCK:
                close()
                stack.append((None, inside))
            stack.extend(inner)
    close()
    return out


def main_text(page: str | None) -> str:
    """The article of one whole page, its blocks joined by an empty line; empty if there is none, and for null.

    Of nodes with equal sums the first in page order is chosen.
    """
    if not page:
        return ""
    found = choose(parse(page))
    return "\n\n".join(blocks(*found)) if found is not None else ""


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of every page as column ``name``; each page on its own, rows stay as they are."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p) for p in batch], dtype=object)

    return pages.withColumn(name, texts(F.col(html_col)))
