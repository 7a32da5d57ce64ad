"""Main text of web pages by composite text density.

Every element of the page's tree gets the characters, tags, link characters and link tags below it, and from them a
density: characters per tag, damped by the share of links against the page's own. An element's density sum adds up
its children's densities; the element with the largest sum holds the article. The least density on its path up to and
including the body is the threshold, and further subtrees beside that path that reach it are content too. Elements for scripts,
styles, menus, headers, footers and asides, and reader comments, have no density. What a role, class or id calls so,
and forms, have none either, unless they hold most of the page's text and its headline or article, as a wrapper
around the whole page does, or without them too little would be left.

Null or empty html gives an empty text; broken markup (open tags, stray end tags, cut-off pages) is read as far as it
goes; ties go to the element that comes first. Repeated rows each get their own equal result; an empty table has no
texts; pages of any length are read whole, one at a time; other columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)|<[/a-zA-Z][^>]*\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

#: Elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
DROPPED = frozenset("script style noscript template iframe head title nav footer aside button select textarea input object svg canvas dialog menu".split())
#: End tags that a start tag implies, up to the element that bounds them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
BOUNDS_P = frozenset("table td th button caption html body article section div main".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form status".split())
#: Names of what is not the article, by the last part of a class or id, or by its first part.
HINTS = re.compile(
    r"ad|ads|adv|advert\w*|adslot|banner|sponsor\w*|promo\w*|sidebar|aside|menu|nav|navbar|navigation|breadcrumbs?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|footer|header|masthead|toolbar|pagination|pager|widget|search"
)
TALK = re.compile(r"comments?|commentlist|disqus|replies|respond")
#: Parts that say how a page looks or what is switched on, and parts of an article that may be called header.
STATES = frozenset("has with without no is not show hide enabled disabled open opened closed active inactive visible collapsed on off left right top bottom full layout page site body".split())
ARTICLE = frozenset("entry post article story section content page".split())
_PARTS = re.compile(r"[A-Z]?[^-_A-Z]+|[A-Z]+")

KEPT, SOFT, TALKED, HARD = range(4)


def _named(value: str) -> int:
    """What a class or id says; parts such as has- or -enabled speak about something else on the page."""
    worst = KEPT
    for token in value.split():
        parts = [x.lower() for x in _PARTS.findall(token)]
        if not parts or len(parts) > 1 and (parts[0] in STATES - {"site", "page"} or parts[-1] in STATES - {"left", "right", "top", "bottom"}):
            continue
        if parts[-1] == "header" and parts[0] in ARTICLE:
            continue
        if TALK.fullmatch(parts[-1]) or TALK.fullmatch(parts[0]):
            worst = TALKED
        elif HINTS.fullmatch(parts[-1]) or HINTS.fullmatch(parts[0]):
            worst = max(worst, SOFT)
    return worst


def _standing(name: str, attributes: str, inside_article: bool) -> int:
    """Whether an element is left out always (HARD), as reader comments (TALKED), or unless it is around the article (SOFT)."""
    if name in DROPPED or name == "header" and not inside_article:
        return HARD
    worst = SOFT if name == "form" else KEPT
    if not attributes or name in ("html", "body", "article", "main"):
        return worst
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            worst = max(worst, _named(value))
        elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            worst = max(worst, SOFT)
    return worst


class Page:
    """The tree of a page as parallel lists; node 0 is the root, children come after their parents."""

    def __init__(self, source: str) -> None:
        self.name, self.parent, self.standing = ["#root"], [-1], [KEPT]
        self.items: list[tuple[int, str | None]] = []  # (node, text), or (node, None) where a block begins or ends
        stack, at, inside, open_p = [0], 0, 0, 0

        def text(upto: int) -> None:
            if upto > at:
                self.items.append((stack[-1], source[at:upto]))

        def pop_to(depth: int) -> None:
            nonlocal inside, open_p
            while len(stack) > depth:
                node = stack.pop()
                open_p -= self.name[node] == "p"
                inside -= self.name[node] in ("article", "main")
                if self.name[node] not in INLINE:
                    self.items.append((stack[-1], None))

        position = 0
        while found := _TOKEN.search(source, position):
            text(found.start())
            at = position = found.end()
            closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not name:
                continue
            name = name.lower()
            if closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if self.name[stack[depth]] == name:
                        pop_to(depth)
                        break
                continue
            if name not in INLINE and open_p:
                for depth in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                    if self.name[stack[depth]] == "p":
                        pop_to(depth)
                        break
                    if self.name[stack[depth]] in BOUNDS_P:
                        break
            if name in CLOSES:
                ended, bounds = CLOSES[name]
                for depth in range(len(stack) - 1, 0, -1):
                    if self.name[stack[depth]] in bounds:
                        break
                    if self.name[stack[depth]] in ended:
                        pop_to(depth)
                        if name != "tr":
                            break
            if name == "br":
                self.items.append((stack[-1], " "))
            node = len(self.name)
            self.name.append(name)
            self.parent.append(stack[-1])
            self.standing.append(_standing(name, attributes, inside > 0))
            if name not in INLINE:
                self.items.append((stack[-1], None))
            if name in VOID or attributes.endswith("/") and name not in ("p", "div", "a"):
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = position = end.end() if end else len(source)
                continue
            stack.append(node)
            open_p += name == "p"
            inside += name in ("article", "main")
        text(len(source))
        self.drop = self._dropped()

    def _dropped(self) -> list[bool]:
        """Which nodes are left out, with all below them."""
        drop = self._unless_around([s >= TALKED for s in self.standing])
        return self._taken_back(drop)

    def _below(self, gone: list[bool]) -> list[bool]:
        """``gone`` for nodes and all below them."""
        gone = list(gone)
        for i in range(1, len(gone)):
            gone[i] = gone[i] or gone[self.parent[i]]
        return gone

    def _taken_back(self, drop: list[bool]) -> list[bool]:
        """A name cannot empty a page: where what is left holds under a tenth of the text and no headline or article, a box
        with more than half of the text stays after all, if it is no list of links, and has a headline if comments do."""
        n = len(self.name)
        hard = self._below([s == HARD for s in self.standing])
        chars, links, left, linked = [0] * n, [0] * n, 0, [False] * n
        headed = [name == "h1" for name in self.name]
        within, marked = [name in ("article", "main", "h1") for name in self.name], False
        for i in range(1, n):
            within[i] = within[i] or within[self.parent[i]]
            linked[i] = linked[self.parent[i]] or self.name[i] == "a"
        for node, piece in self.items:
            if piece and not hard[node]:
                size = len("".join(piece.split()))
                chars[node] += size
                links[node] += size * linked[node]
                left += size * (not drop[node])
                marked = marked or not drop[node] and within[node]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p], links[p], headed[p] = chars[p] + chars[i], links[p] + links[i], headed[p] or headed[i]
        if marked or 10 * left >= chars[0]:
            return drop
        stays = lambda i: 2 * chars[i] > chars[0] and 3 * links[i] <= chars[i] and (self.standing[i] == SOFT or headed[i])
        return self._below([s == HARD or s != KEPT and not stays(i) for i, s in enumerate(self.standing)])

    def _unless_around(self, hard: list[bool]) -> list[bool]:
        n, hard = len(hard), self._below(hard)
        chars = [0] * n
        for node, piece in self.items:
            if piece and not hard[node]:
                chars[node] += len("".join(piece.split()))
        around = [name in ("article", "main", "h1") for name in self.name]
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            around[self.parent[i]] = around[self.parent[i]] or around[i]
        drop = hard
        for i in range(1, n):
            drop[i] = drop[i] or drop[self.parent[i]] or self.standing[i] == SOFT and not (around[i] and 2 * chars[i] > chars[0])
        return drop

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite density and density sum of every node."""
        n = len(self.name)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, piece in self.items:
            if piece and not self.drop[node]:
                chars[node] += len("".join(piece.split()))
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.name[i] == "a"
            link_chars[i] = chars[i] if in_link[i] else 0
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            if not self.drop[i]:
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (self.name[i] == "a")
        body = next((i for i, x in enumerate(self.name) if x == "body"), 0)
        page_share = link_chars[body] / max(1, chars[body])
        density, total = [0.0] * n, [0.0] * n
        for i in range(n):
            if chars[i] and not self.drop[i]:
                c, t, lc, lt = chars[i], max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i])
                base = log(c / max(1, c - link_chars[i]) * link_chars[i] + page_share * c + e)
                density[i] = c / t * max(0.0, log(max(1.0, c / lc * t / lt)) / max(1.0, base))
        for i in range(n - 1, 0, -1):
            if self.name[i] not in INLINE:  # a run of inline elements is its block's own text
                p = self.parent[i]
                while self.name[p] in INLINE:
                    p = self.parent[p]
                total[p] += density[i]
        return density, total

    def content(self) -> list[bool]:
        """Which nodes belong to the article."""
        density, total = self.densities()
        n = len(self.name)
        best = max((i for i in range(n) if self.name[i] not in INLINE), key=lambda i: (total[i] or density[i] * 1e-9, -i))
        path, i = [], best
        while i >= 0 and self.name[i] not in ("body", "html", "#root"):
            path.append(i)
            i = self.parent[i]
        top = i
        threshold = min([density[p] for p in path] + [density[top]] * (top >= 0) or [density[best]])
        on_path = {*path, top}
        kept = [False] * n
        for i in range(n):
            p = self.parent[i]
            kept[i] = i == best or p >= 0 and kept[p] or p in on_path and i not in on_path and self.name[i] not in INLINE and density[i] >= threshold > 0 and total[i] > 0
        return kept


def extract(source: str | None) -> str:
    """The article's blocks in page order, one a line."""
    if not source:
        return ""
    page = Page(source)
    kept, lines, line = page.content(), [], []
    for node, piece in [*page.items, (0, None)]:
        if piece is None:
            if line:
                block = " ".join("".join(line).split())
                if block:
                    lines.append(block)
                line = []
        elif kept[node] and not page.drop[node]:
            line.append(html.unescape(piece))  # piece by piece: no reference is formed across tags
    return "\n".join(lines)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""

    @F.pandas_udf("text string, n_chars bigint")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for sources in batches:
            texts = [extract(h) for h in sources]
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(id_col, url_col, read(html_col).alias("r")).select(id_col, url_col, "r.*")
