"""Main text of web pages by composite text density.

For every DOM node the characters per tag are computed and adjusted for links; a
node's density sum adds up its children.  The node with the largest sum names the
content; the smallest density on the path from the body to it is the threshold above
which other subtrees count as content too.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: a start tag of the key ends an open element of the value, as browsers do
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("html body table td th ul ol dl div article section main".split())
#: elements that are never part of an article
_OUT = frozenset(
    "head script style noscript template nav footer aside form button select input textarea dialog iframe object svg canvas "
    "menu noembed noframes xmp title".split()
)
#: names in class, id or role that mark what surrounds an article
_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription sidebar sidebars complementary menu menus nav "
    "navbar navigation breadcrumb breadcrumbs footer contentinfo header masthead comment comments commentlist disqus replies "
    "share sharing social related recommended recommendations widget widgets toolbar pagination pager login signin signup search "
    "skip".split()
)
_KEEP = frozenset("html body article main".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


def _is_out(name: str, attrs: str, in_article: bool) -> bool:
    if name in _OUT or (name == "header" and not in_article):
        return True
    if name in _KEEP or "=" not in attrs:
        return False
    for found in _NAMES.findall(attrs):
        words = _SPLIT.split(html.unescape("".join(found)).lower())
        if any(w in _OUT_NAMES for w in words) and not (in_article and "header" in words):
            return True
    return False


class Page:
    """The nodes of a page in document order, with the texts and block breaks between them."""

    def __init__(self, source: str):
        self.name, self.parent, self.out, self.last = ["#"], [-1], [False], [0]
        self.texts: list[tuple[int, str | None]] = []  # (node, text), None is a break between blocks
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, at, texts = [0], 0, self.texts
        articles = 0
        opened: dict[str, list[int]] = {}  # places in the stack by name, so that no tag searches it
        scopes = [0]

        def shut(depth: int) -> int:
            gone = 0
            while len(stack) > depth:
                node = stack.pop()
                self.last[node] = len(self.name)
                opened[self.name[node]].pop()
                if self.name[node] in _SCOPE:
                    scopes.pop()
                gone += self.name[node] in ("article", "main")
            return gone

        tail = source.rfind(">") + 1  # no tag ends behind it
        for tag in iter(lambda: _TAG.search(source, at, tail), None):
            if tag.start() > at:
                texts.append((stack[-1], source[at : tag.start()]))
            at = tag.end()
            if tag[0].startswith("<!--") and not tag[0].endswith("-->"):
                at = len(source)  # a comment that is never closed
                break
            name = tag["name"] or tag["name2"]
            if not name:
                continue
            name = name.lower()
            if tag["end"] or tag["end2"]:
                depth = opened[name][-1] if opened.get(name) else 0
                if depth and (name in _BLOCK or scopes[-1] <= depth):
                    articles -= shut(depth)
                if name in _BLOCK:
                    texts.append((stack[-1], None))
                continue
            closes = _ENDS.get(name) or ({"p"} if name in _BLOCK else ())
            depth = max((opened[c][-1] for c in closes if opened.get(c)), default=0)
            if depth and scopes[-1] <= depth:
                articles -= shut(depth)
            node = len(self.name)
            self.name.append(name)
            self.parent.append(stack[-1])
            self.last.append(node + 1)
            attrs = tag["attrs"] if tag["name"] else tag["attrs2"]
            self.out.append(self.out[stack[-1]] or _is_out(name, attrs, articles > 0))
            if name in _BLOCK:
                texts.append((node, None))
            elif name == "br":
                texts.append((node, " "))
            if name in _RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
                if name == "textarea":
                    texts.append((node, source[at : close.start()]))
                at = close.end()
                continue
            if name not in _VOID and not attrs.endswith("/"):
                opened.setdefault(name, []).append(len(stack))
                if name in _SCOPE:
                    scopes.append(len(stack))
                stack.append(node)
                articles += name in ("article", "main")
        if at < len(source):
            texts.append((stack[-1], source[at:]))
        for node in stack:
            self.last[node] = len(self.name)

    def content(self) -> list[tuple[int, int]]:
        """Subtrees (first node, node after the last) that hold the main text."""
        n = len(self.name)
        chars, tags, link_chars, link_tags = [0] * n, [1] * n, [0] * n, [0] * n
        in_link = [False] * n
        for node in range(1, n):
            in_link[node] = self.name[node] == "a" or in_link[self.parent[node]]
            link_tags[node] = int(self.name[node] == "a")
        for node, text in self.texts:
            if text and not self.out[node]:
                size = len(_SPACE.sub(" ", text).strip())
                chars[node] += size
                if in_link[node]:
                    link_chars[node] += size
        for node in range(n - 1, 0, -1):
            if not self.out[node]:
                up = self.parent[node]
                chars[up] += chars[node]
                tags[up] += tags[node]
                link_chars[up] += link_chars[node]
                link_tags[up] += link_tags[node]
        body = next((i for i in range(n) if self.name[i] == "body" and not self.out[i]), 0)
        if self.parent[body] >= 0 and chars[body] < chars[0]:
            body = 0  # text outside the body element
        if not chars[body]:
            return []
        ratio = link_chars[body] / chars[body]
        density, total = [0.0] * n, [0.0] * n
        for node in range(n - 1, -1, -1):
            c, lc = chars[node], link_chars[node]
            if c and not self.out[node]:
                spread = math.e + c / max(c - lc, 1) * lc + ratio * c
                adjust = math.log1p(c / max(lc, 1) * tags[node] / max(link_tags[node], 1)) / math.log1p(math.log(spread))
                density[node] = c / tags[node] * adjust
                if node:
                    total[self.parent[node]] += density[node]
        inside = range(body, self.last[body])
        best = max(inside, key=lambda i: (max(total[i], density[i] if not total[i] else 0.0), -i))
        threshold, node = density[best], best
        while node != body and node > 0:
            node = self.parent[node]
            if density[node]:
                threshold = min(threshold, density[node])
        chosen: list[tuple[int, int]] = []
        node = body
        while node < self.last[body]:
            if self.out[node]:
                node = self.last[node]
            elif node == best or (node not in self._path(best, body) and density[node] >= threshold and self.name[node] != "body"):
                chosen.append((node, self.last[node]))
                node = self.last[node]
            else:
                node += 1
        # an article element around content is content as a whole
        wide = []
        for first, last in chosen:
            node = first
            while node > body:
                if self.name[node] in ("article", "main"):
                    first, last = node, self.last[node]
                node = self.parent[node]
            if not wide or first >= wide[-1][1]:
                wide.append((first, last))
        landmarks = [w for w in wide if self.name[w[0]] in ("article", "main")]
        # others are left out only where the largest sum lies in an article itself
        return landmarks if any(first <= best < last for first, last in landmarks) else wide

    def _path(self, node: int, body: int) -> set[int]:
        if getattr(self, "_cached", None) is None:
            path = set()
            while node >= 0:
                path.add(node)
                node = self.parent[node]
            self._cached = path
        return self._cached

    def text(self) -> str:
        taken = bytearray(len(self.name))
        for first, last in self.content():
            taken[first:last] = b"\1" * (last - first)
        blocks, now = [], []
        for node, text in self.texts:
            if text is None:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif taken[node] and not self.out[node]:
                now.append(text)
        if now:
            blocks.append("".join(now))
        clean = (_SPACE.sub(" ", html.unescape(b)).strip() for b in blocks)
        return "\n".join(b for b in clean if b)


def main_text(source: str | None) -> str:
    """Main text of one page; NULL, empty and text-free pages give an empty string."""
    return Page(source).text() if source else ""


def extract_text(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns of every row with text and n_chars (code points).

    Rows are independent: repeated rows give repeated results, NULL html is empty, a long
    page costs memory in proportion to itself.  A kept column named like a result is left
    out.
    """
    keep = tuple(k for k in keep if k not in ("text", "n_chars"))
    wide = pages.select(*keep, F.col(column).alias("_source"))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in range(0, part.num_rows, 256):
                piece = part.slice(row, 256)
                texts = [main_text(s) for s in piece.column(piece.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*piece.schema.names[:-1], "text", "n_chars"],
                )

    fields = [f for f in wide.schema.fields if f.name != "_source"]
    return wide.mapInArrow(work, T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
