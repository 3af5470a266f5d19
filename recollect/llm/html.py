"""Main text of web pages by minimum-cut labelling.

A page becomes a sequence of text blocks with their place in the element tree. A linear classifier gives each block a cost for
either label, content or boilerplate: from the kind of the elements around it, link density, length and punctuation. These
costs are capacities from and to the two terminals of a network. Blocks next to each other, and neighbours in one parent element,
are tied by edges whose capacity falls with their distance in the tree. The minimum cut is the labelling with the least sum of costs
and cut ties. Blocks whose cost outweighs all their ties are settled beforehand, which doesn't change the cut; the rest goes
through max-flow.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import common

OUT = "page_id long, url string, text string, n_chars long"
NEAR, SIBLING, CERTAIN, HINTED = 1.0, 0.5, 1e6, 8.0

# Names of elements and hints.
RAW = {"script", "style", "textarea", "title", "template", "iframe", "canvas", "select", "head"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr object".split())
INLINE |= set("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation".split())
INLINE |= set("svg circle clippath defs desc ellipse filter g image line lineargradient marker mask path pattern polygon polyline radialgradient rect stop symbol text textpath tspan use".split())
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
AWAY = {"nav", "footer", "menu", "dialog", "button"}
FORMS = {"form", "fieldset"}
CODE = {"script", "style"}
MAIN = {"article", "main"}
HINT = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menus?|menubar|headers?|masthead|topbar|footers?|sidebars?|aside|rail|ads?|adverts?|advertisements?|advertising|adbox|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modal"
    r"|comments?|commentlist|replies|disqus|respond|forms?|login|signup|subscribe|newsletter|search|share|sharing|social|related|recommended|breadcrumbs?|pagination|pager|widgets?|copyright|legal|toolbar|hidden)(?=$|[\s_-])",
    re.I,
)
#: Hints that are also words of a subject: inside content they cost about what a long paragraph earns, and it stays content.
WEAK = re.compile(r"(?:^|(?<=[\s_-]))(?:headers?|search|share|sharing|social|related|recommended|legal|copyright|forms?)(?=$|[\s_-])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|post|story|entry|content|body|main|text)(?=$|[\s_-])", re.I)
HEAD = re.compile(r"(?:^|(?<=[\s_-]))headers?(?=$|[\s_-])", re.I)

#: Where a quotation mark is never closed, tags are read without regard to marks from there on, so no page is scanned twice.
PLAIN_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)", re.S)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*(?:>|\Z)", re.S)
OPENING = re.compile(r"</?[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Element:
    """An open element: its number, the one around it, and what it says about the text inside."""

    __slots__ = ("away", "cost", "depth", "form", "good", "heading", "number", "parent", "tag", "wrapped")

    def __init__(self, tag: str, number: int, parent: Element | None, away: bool, good: bool, cost: float):
        self.tag, self.number, self.parent, self.away, self.good, self.cost = tag, number, parent, away, good, cost
        self.form = parent.form if parent and parent.form else number if tag in FORMS else 0  # the outermost one
        self.wrapped = bool(parent and parent.wrapped or self.form and good and not parent.good)  # content that begins inside of it
        self.depth = parent.depth + 1 if parent else 0
        self.heading = 3 if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else max(0, parent.heading - 1) if parent else 0  # so many levels down


ROOT = Element("", 0, None, False, False, 0.0)


class Block:
    __slots__ = ("away", "element", "form", "heading", "hints", "linked", "main", "text", "wrapped")

    def __init__(self, text: str, linked: int, element: Element):
        self.text, self.linked, self.element = text, linked, element
        self.form, self.wrapped = element.form, element.wrapped
        self.away, self.main, self.hints, self.heading = element.away, element.good, element.cost, element.heading > 0


def steps_between(a: Element, b: Element) -> int:
    """Edges of the tree between two elements."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def hinted(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool, int]:
    """(boilerplate for certain by name, role or style; content; boilerplate by a hint: 0 no, 1 weakly, 2 strongly). A class that speaks for
    content outweighs the others of its element; a header of content is part of it."""
    hint, away, good = 2 * (tag == "aside"), tag in AWAY or tag == "header" and not in_main, tag in MAIN
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), entities.unescape(next((v for v in values if v), ""))
            if name in ("class", "id"):
                for word in value.split():
                    content = bool(GOOD.search(word))
                    against = bool(HINT.search(HEAD.sub("", word) if content or in_main else word))
                    if against and tag not in ("html", "body") and tag not in MAIN:
                        hint = max(hint, 2 if HINT.search(WEAK.sub("", word)) else 1)
                    good |= content and not against
            elif name == "role":
                away |= value.lower() in ROLES
                good |= value.lower() in ("main", "article")
            elif name == "style":
                away |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif name == "hidden" or value.lower() == "true":
                away = True
    return away, good, 0 if good else hint


NAME = re.compile(r"<(?!!)/?([a-zA-Z][^\s/>]*)")


def end_of_raw(page: str, tag: str, attributes: str, at: int, ends: dict[str, int]) -> int:
    """Where the text goes on behind the start tag of an element whose content is no text. Its end tag counts if it opens no second time
    before that; else it ends at the next tag of a block, a script or style at the end of the page. `ends` holds the next end tags found."""
    if tag not in CODE and attributes.rstrip().endswith("/"):
        return at
    if ends.get(tag, -1) < at:  # each end tag is searched for once
        found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
        ends[tag] = found.start() if found else len(page)
    end = ends[tag]
    if tag in CODE or end < len(page) and not re.compile(rf"<{re.escape(tag)}(?=[\s/>])", re.I).search(page, at, end):
        return min(len(page), page.find(">", end) + 1 or len(page)) if end < len(page) else len(page)
    if tag == "head":
        return at  # its end may be left out
    for m in NAME.finditer(page, at):
        if m[1].lower() not in INLINE and m[1].lower() not in ("option", "optgroup"):
            return m.start()
    return len(page)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. White space is one space, trimmed; empty blocks are left out. Unclosed elements end with
    the element around them, a paragraph at the next block."""
    out: list[Block] = []
    here, open_tags = ROOT, Counter()
    parts: list[str] = []
    linked = links = at = number = 0
    pattern, ends = TOKEN, {}

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, here))
        parts, linked = [], 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece)

    def leave() -> None:
        nonlocal here
        open_tags[here.tag] -= 1
        here = here.parent

    while at < len(page):
        mark = page.find("<", at)
        if mark < 0:
            text(page[at:])
            break
        text(page[at:mark])
        m = pattern.match(page, mark)
        if m is None:
            at = mark
            if pattern is TOKEN and OPENING.match(page, mark):  # a tag that quotation marks keep open to the end
                pattern = PLAIN_TOKEN
            elif page.find(">", mark) < 0:
                text(page[mark:])
                break
            else:
                text("<")
                at += 1
            continue
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if m[1] else 1))
            continue
        flush()
        links = 0
        if m[1]:
            if open_tags[tag]:
                while here.tag != tag:
                    leave()
                leave()
            continue
        if tag in RAW:
            at = end_of_raw(page, tag, m[3], at, ends)
            continue
        if tag in VOID or m[3].endswith("/") and tag not in ("p", "div"):
            continue
        while here is not ROOT and (here.tag == "p" or here.tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
            leave()
        number += 1
        away, good, hint = hinted(tag, m[3], here.good)
        strong = hint == 2 and here.good  # no part of the content around it
        here = Element(tag, number, here, here.away or away, good or here.good and not strong, max(here.cost, 2 * HINTED if strong else HINTED if hint else 0.0))
        open_tags[tag] += 1
    flush()
    return out


def wrappers(page_blocks: list[Block]) -> set[int]:
    """Forms that are no forms but stand around the page's text: marked content begins inside, or they hold three long blocks and over half of all text."""
    size, long, out = Counter(), Counter(), set()
    for b in page_blocks:
        if not b.away:
            size[b.form] += len(b.text) - b.linked
            long[b.form] += len(b.text) - b.linked >= 80
            if b.form and b.wrapped and b.main:
                out.add(b.form)
    return out | {f for f, n in size.items() if f and long[f] >= 3 and 2 * n > sum(size.values())}


def costs(page_blocks: list[Block]) -> list[float]:
    """Cost of the label boilerplate less that of content: positive speaks for content."""
    marked = any(b.main and not b.away and not b.hints for b in page_blocks)
    wraps = wrappers(page_blocks)
    out = []
    for b in page_blocks:
        if b.away or b.form and b.form not in wraps:
            out.append(-CERTAIN)
            continue
        n = len(b.text)
        density = min(1.0, b.linked / n)
        stops = sum(b.text.count(c) for c in ".,;!?")
        score = -1.0 - b.hints + min(3.0, n / 80) + min(1.5, 0.5 * stops) - 4 * density
        if b.heading:
            score += 0.5
        if b.main:
            score += 6.0
        elif marked:
            score -= 6.0
        out.append(score)
    return out


def ties(page_blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours on the page, by distance in the tree, and the last block before with the same parent."""
    out, last = [], {}
    for i, b in enumerate(page_blocks):
        if i:
            out.append((i - 1, i, NEAR / (1 + steps_between(page_blocks[i - 1].element, b.element))))
        parent = b.element.parent
        if parent in last and last[parent] != i - 1:
            out.append((last[parent], i, SIBLING))
        last[parent] = i
    return out


def max_flow_side(n: int, gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side (content) of the minimum cut of a network with terminals n and n + 1, by shortest augmenting paths in
    phases. Among minimum cuts, the one with the least content."""
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def add(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gains):
        add(n, i, g, 0.0) if g > 0 else add(i, n + 1, -g, 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[n], queue = 0, deque([n])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[n + 1] < 0:
            return [x >= 0 for x in level[:n]]
        nxt, path, a = [0] * (n + 2), [], n
        while True:
            if a == n + 1:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-12)
                a = to[path[k] ^ 1]
                del path[k:]
            while nxt[a] < len(head[a]):
                e = head[a][nxt[a]]
                if room[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                nxt[a] += 1
            else:
                if a == n:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]


def minimum_cut(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for content. First settles blocks whose gain outweighs their ties, and hands the ties on to their neighbours."""
    n, gains = len(gains), list(gains)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(gains[i]) > sum(near[i].values()):
            label[i] = gains[i] > 0
            for j, c in near[i].items():
                gains[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        kept = [(place[i], place[j], c) for i in rest for j, c in near[i].items() if i < j]
        for i, side in zip(rest, max_flow_side(len(rest), [gains[i] for i in rest], kept), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, minimum_cut(costs(found), ties(found)), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. Null html is empty; a page without content has an empty text; null ids and
    urls and repeated rows stay as they are; an empty table gives no rows. A very long page is read once, whatever its nesting and
    open quotation marks. Other columns aren't read."""
    common.small_batches(pages.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in common.chunks(whole, text=2):
                texts = [main_text(t) for t in batch.column(2).to_pylist()]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, OUT)
