"""Main text of web pages by tree scoring.

A page becomes a tree of elements; menus, adverts, forms and the like are left out by their tags, roles
and the words of their class or id. Each paragraph gives points for its length and commas, less its
share of link text, to its parent, half of them to the next ancestor and ever less to those above. The
container with the most points, discounted by its own link density, is kept with those siblings that
score nearly as much. All text of what is kept is returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm.common import bounded_batches, fresh

_TOKEN = re.compile(r"<!--[\s\S]*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_COMMAS = re.compile(r"[,،、，;；]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that may not stand in a paragraph and so end an open one.
ENDS_P = BLOCK - frozenset("body caption html legend tbody td tfoot th thead tr".split())
INLINE_FORMAT = frozenset("a b big code em font i nobr s small span strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("script style noscript template iframe object embed applet svg math canvas audio video map nav footer aside header form fieldset button select option datalist textarea input label dialog menu head title noembed noframes xmp".split())
#: Never left out for their names.
HELD = frozenset("html body article main".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tablist".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs combx comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header hidden masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager paginate pagination paywall popup promo promotion promoted recommended related replies reply respond rss share sharing shoutbox sidebar skip skyscraper social sponsor sponsored subscribe subscription supplemental taboola tags toolbar toc widget".split()
)
#: Names of containers of articles; such words weigh for a container.
LIKELY = frozenset("article body content entry main post story text".split())
#: Which open elements an element of the key's kind ends, and what they are looked for within.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
PRIOR, KEEP_SHARE, KEEP_LEAST = 25.0, 0.2, 10.0
#: A paragraph gives points to so many ancestors.
LEVELS = 12


class Page:
    """The tree of a page: parallel lists by node, and its text pieces and block borders in order."""

    def __init__(self, html: str):
        self.tag, self.parent, self.prior, self.out = ["#"], [-1], [0.0], [False]
        #: By node: the nearest block at or above it, and whether a link lies between.
        self.block, self.link = [0], [False]
        self.events: list[tuple[int, str | None]] = []  # (node, text), or (node, None) for a border
        self._parse(html)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        names: set[str] = set()
        role = hidden = ""
        if attributes and not attributes.isspace():
            for k, *v in _ATTRIBUTE.findall(attributes):
                k, v = k.lower(), v[0] or v[1] or v[2]
                if k in ("class", "id"):
                    names.update(w.lower() for w in _WORD.findall(v))
                elif k == "role":
                    role = v.strip().lower()
                elif k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and re.search(r"display\s*:\s*none", v)):
                    hidden = k
        out = self.out[parent] or tag in DROPPED or bool(hidden) or (tag not in HELD and (role in DROPPED_ROLES or not names.isdisjoint(DROPPED_NAMES)))
        out = out or (tag == "article" and "comment" in names)
        self.tag.append(tag)
        self.parent.append(parent)
        self.out.append(out)
        self.block.append(len(self.tag) - 1 if tag in BLOCK else self.block[parent])
        self.link.append(tag not in BLOCK and (tag == "a" or self.link[parent]))
        self.prior.append(2 * PRIOR if tag in ("article", "main") or role in ("main", "article") else PRIOR if names & LIKELY else 0.0)
        return len(self.tag) - 1

    def _parse(self, html: str) -> None:
        stack, at, events = [0], 0, self.events
        # Where in the stack elements of a tag, and blocks (tag ""), are open.
        places: dict[str, list[int]] = {}
        scan = _TOKEN.search
        while m := scan(html, at):
            if m.start() > at:
                self._text(stack[-1], html[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if not m[1]:
                if tag in ENDS_P:
                    self._close(stack, places, ("p",), ("table", "td", "button", "object"))
                if tag in CLOSES:
                    self._close(stack, places, *CLOSES[tag])
                node = self._open(tag, m[3], stack[-1])
                if tag in BLOCK:
                    events.append((node, None))
                elif tag == "br":
                    events.append((stack[-1], " "))
                if tag in RAW:
                    end = re.compile("</" + tag, re.I | re.A).search(html, at)
                    at = end.start() if end else len(html)
                if tag in RAW or tag not in VOID:
                    places.setdefault(tag, []).append(len(stack))
                    if tag in BLOCK:
                        places.setdefault("", []).append(len(stack))
                    stack.append(node)
            elif places.get(tag):
                depth = places[tag][-1]
                blocks = places.get("")
                inner = bool(blocks) and blocks[-1] >= depth
                if not (tag in INLINE_FORMAT and inner):
                    if inner:
                        events.append((stack[depth], None))
                    self._cut(stack, places, depth)
        if at < len(html):
            self._text(stack[-1], html[at:])

    def _cut(self, stack: list[int], places: dict[str, list[int]], depth: int) -> None:
        while len(stack) > depth:
            tag = self.tag[stack.pop()]
            places[tag].pop()
            if tag in BLOCK:
                places[""].pop()

    def _close(self, stack: list[int], places: dict[str, list[int]], tags: Iterable[str], within: Iterable[str]) -> None:
        """Ends the innermost open element of `tags`, unless one of `within` lies inside of it."""
        deepest = lambda some: max((p[-1] for t in some if (p := places.get(t))), default=0)
        depth = deepest(tags)
        if depth and depth >= deepest(within):
            self.events.append((stack[depth], None))
            self._cut(stack, places, depth)

    def _text(self, node: int, text: str) -> None:
        if not self.out[node]:
            self.events.append((node, unescape(text) if "&" in text else text))

    def text(self) -> str:
        keep = self._kept()
        blocks: list[str] = []
        held: list[str] = []
        for node, piece in self.events:
            if piece is None:
                if held:
                    blocks.append(" ".join("".join(held).split()))
                    held = []
            elif keep[node]:
                held.append(piece)
        blocks.append(" ".join("".join(held).split()))
        return "\n".join(b for b in blocks if b)

    def _kept(self) -> list[bool]:
        tag, parent, n = self.tag, self.parent, len(self.tag)
        # Text of each paragraph (nearest block above a piece), and how much of it is in links.
        texts: dict[int, list[str]] = {}
        linked: dict[int, int] = {}
        for node, piece in self.events:
            if piece is None or piece.isspace() or self.out[node]:
                continue
            block, link = self.block[node], self.link[node]
            texts.setdefault(block, []).append(piece)
            if link:
                linked[block] = linked.get(block, 0) + len(piece.strip())
        points, size, links = [0.0] * n, [0] * n, [0] * n
        own: dict[int, tuple[int, int]] = {}
        for block, pieces in texts.items():
            t = "".join(pieces).strip()
            length, link = len(t), linked.get(block, 0)
            gain = 0.0 if tag[block] in HEADINGS else (1.0 if length >= 25 else 0.1) + len(_COMMAS.findall(t)) + min(length / 100, 3.0)
            gain *= 1 - min(1.0, link / max(length, 1))
            level, node = 0, block
            if tag[block] in ("p", "pre", "td", "th", "li", "dd", "dt", "blockquote", *HEADINGS):
                node = parent[block]
                size[block] += length
                links[block] += link
                own[block] = (length, link)
            size[node] += length
            links[node] += link
            while node >= 0 and level < LEVELS:
                points[node] += gain if level == 0 else gain / 2 if level == 1 else gain / (3 * level)
                level += 1
                node = parent[node]
        # A paragraph that isn't a container holds its text already: only what lies in others goes up.
        up, up_links = size[:], links[:]
        for block in own:
            up[block], up_links[block] = up[block] - own[block][0], up_links[block] - own[block][1]
        for k in range(n - 1, 0, -1):
            if up[k]:
                for x, y in ((size, up), (links, up_links)):
                    x[parent[k]] += y[k]
                    y[parent[k]] += y[k]
        final = [0.0] * n
        for k in range(n):
            if points[k] > 0 and not self.out[k]:
                final[k] = (points[k] + self.prior[k]) * (1 - min(1.0, links[k] / max(size[k], 1)))
        keep = [False] * n
        best = max(range(n), key=lambda k: (final[k], -k))
        if final[best] <= 0:
            # Only headings or links: what isn't left out, if it has plain text.
            if not any(size[k] for k in range(n)):
                return keep
            best = 0
        roots = {best}
        if best > 0:
            least = max(KEEP_LEAST, KEEP_SHARE * final[best])
            strict = tag[best] in ("article", "main")
            for k in range(n):
                if parent[k] != parent[best] or k == best or self.out[k]:
                    continue
                density = links[k] / max(size[k], 1)
                near = final[k] >= least
                loose = not strict and ((tag[k] == "p" and size[k] > 80 and density < 0.25) or (tag[k] in HEADINGS and density < 0.5))
                if near or loose:
                    roots.add(k)
        for k in range(n):
            keep[k] = not self.out[k] and (k in roots or (parent[k] >= 0 and keep[parent[k]]))
        return keep


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def extracted(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """`pages` with the main text in column `into` (renamed if taken).

    Null, empty and textless pages give an empty text. Character references are decoded, white space in
    a block is one space, blocks are joined by a line feed. All rows and other columns are kept. No shuffle.
    """
    bounded_batches(pages.sparkSession)

    def extract(texts: pa.Array) -> pa.Array:
        return pa.array([main_text(t) for t in texts.to_pylist()], pa.string())

    return pages.withColumn(fresh(pages, into), F.arrow_udf(extract, T.StringType())(F.col(html).cast("string")))
