"""Main-text extraction by composite text density.

A page is parsed to a tree in one pass. Elements that hold no article text by their kind (menus, footers, forms, scripts
and the like, by tag or role, and what is hidden) are left out. Every other node gets its characters per tag, adjusted by
the share of link characters and link tags, and weighed down where its class or id hints at something else, and to an
eighth where it names it (adverts, menus, reader comments). The node whose children's densities have the greatest sum is the core; the least density
on its path to the body is the threshold, and every node that reaches it yields the greatest-sum subtree below it. A core
inside an article (or else main) element extends to all of it, and other articles of the same main stay if they reach the
threshold. Inside what is selected, hinted nodes that do not reach the threshold, and lists of links, go, and named ones
that do not, at an eighth of their density, outweigh all beside them; the core and what holds it stay, whatever they are
called.

Defined results: null or empty html gives the empty text; broken, unclosed and truncated markup is read as browsers do
in the main (a tag that does not end is dropped, an unclosed paragraph ends at the next block); repeated pages come as
often as they are there; other columns are ignored. Time is linear in the page, however deep it nests.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*(?:>|\Z)", re.S)
REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*>")  # of a tag, after its name
REST_MOST = 1 << 14  # characters within which quotes are paired; beyond, a tag ends at the next >
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NO_TEXT = frozenset(
    "script style noscript template head title iframe object embed svg math canvas audio video map nav aside footer form button select textarea input"
    " label dialog menu noembed noframes xmp datalist output progress meter fieldset".split()
)
ARTICLE = frozenset(("article", "main"))
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note".split())
#: Words in a class or id that name something other than the article, unless they stand in the name of a wrapper.
NO_TEXT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors cookie cookies consent gdpr popup modal newsletter nav"
    " navbar navigation menu menus breadcrumb breadcrumbs sidebar comment comments commentlist disqus respond replies footer masthead login signin"
    " pagination pager toolbar".split()
)
NO_TEXT_STARTS = ("advert", "cookie", "newsletter", "sidebar", "breadcrumb", "sponsor", "footer", "navbar", "navigation")
#: Words that hint at something other than the article.
HINTS = frozenset(
    "banner promo promotion promoted notice notices notification notifications alert alerts overlay subscribe subscription signup aside widget widgets related"
    " recommended recommendations share sharing social reply discussion foot search copyright legal disclaimer hidden skip".split()
)
HEADER_NAMES = frozenset(("header", "topbar", "head"))
TEXT_NAMES = frozenset("article post entry story content main body text".split())
WRAPPER_NAMES = TEXT_NAMES | frozenset("has with without no wrap wrapper container layout page row col columns grid site".split())
HINT_WEIGHT, HINT_SHARE = 0.25, 0.2  # of a hinted node's density; of the core's characters that it needs to stay
NAME_WEIGHT, NAME_SHARE = 0.125, 0.5  # of a named node's density; of its parent's sum of densities that it then needs to stay
LINK_LIST, LINK_SHARE, LINK_CHARS = 3, 0.8, 80  # links, share of their characters, and characters a link at most: a list of links
CLOSES = {  # an element that begins ends open ones of these kinds, up to the barrier
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
}
CLOSES |= {"tbody": CLOSES["thead"], "tfoot": CLOSES["thead"]}
SCOPE = frozenset("table td th caption button object template html".split())
LINKS = frozenset(("a",))
LISTS = frozenset("ul ol dl div section table p aside".split())


class Open:
    """The stack of open elements; where elements of a name are open is found without a walk."""

    def __init__(self):
        self.nodes: list[int] = [0]
        self.names: list[str] = ["html"]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of open block elements

    def push(self, node: int, name: str) -> None:
        self.at.setdefault(name, []).append(len(self.nodes))
        if name in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.names.append(name)

    def cut(self, size: int) -> None:
        while len(self.nodes) > size:
            self.nodes.pop()
            name = self.names.pop()
            self.at[name].pop()
            if name in BLOCK:
                self.blocks.pop()

    def last(self, names) -> int:
        return max((places[-1] for n in names if (places := self.at.get(n))), default=0)

    def close(self, names: tuple[str, ...], barrier) -> None:
        """Ends open elements of these names above the last barrier: one name's last, or the outermost of several."""
        wall = self.last(barrier)
        if len(names) == 1:
            at = self.last(names)
            if at > wall:
                self.cut(at)
            return
        found = [places[k] for n in names if (places := self.at.get(n)) and (k := bisect_right(places, wall)) < len(places)]
        if found:
            self.cut(min(found))

    def end(self, name: str) -> None:
        """An end tag: a block ends wherever it is open, other elements only inside the innermost block."""
        at = self.last((name,))
        if at and (name in BLOCK or at > (self.blocks[-1] if self.blocks else 0)):
            self.cut(at)


class Page:
    """Nodes as parallel lists, in document order; segments of text with their node and block."""

    def __init__(self, html: str, strict: int = 2):
        """strict: 2 heeds what classes and ids name, 1 only where they do not name text as well, 0 not at all."""
        self.strict = strict
        self.tag, self.parent = ["html"], [-1]
        self.dead, self.hinted, self.named, self.linked, self.in_article = [False], [False], [False], [False], [False]
        self.segments: list[tuple[int, int, str]] = []
        self.parse(html)

    def parse(self, html: str) -> None:
        tags, dead, linked = self.tag, self.dead, self.linked
        stack, at, block, segments = Open(), 0, 0, self.segments
        for_raw: dict[str, re.Pattern] = {}
        end = len(html)
        while at < end:
            m = TAG.search(html, at)
            stop = m.start() if m else end
            if stop > at and not dead[stack.nodes[-1]]:
                piece = html[at:stop]
                segments.append((stack.nodes[-1], block, unescape(piece) if "&" in piece else piece))
            if not m:
                break
            at, name = m.end(), m[2]
            if not name:
                continue
            name = name.lower()
            rest = REST.match(html, at, min(end, at + REST_MOST))
            close = rest.end() if rest else html.find(">", at) + 1
            if not close:
                break
            attributes, at = html[at : close - 1], close
            if m[1]:
                block += name in BLOCK
                stack.end(name)
                continue
            if name in BLOCK:
                block += 1
                stack.close(("p",), SCOPE)
            if name in CLOSES:
                stack.close(*CLOSES[name])
            if name == "html" or name == "body" and stack.at.get("body"):
                continue
            if name == "body":
                stack.cut(1)
            top = stack.nodes[-1]
            node = len(tags)
            tags.append(name)
            self.parent.append(top)
            inside = self.in_article[top] or name in ARTICLE
            self.in_article.append(inside)
            linked.append(linked[top] or name in LINKS)
            kind = self.other(attributes, inside) if attributes and name != "body" else 0
            dead.append(dead[top] or name in NO_TEXT or (name == "header" and not self.in_article[top]) or kind == 3)
            self.hinted.append(kind == 1)
            self.named.append(kind == 2)
            if name == "br" and not dead[node]:
                segments.append((top, block, " "))
            if name in RAW:
                find = for_raw.setdefault(name, re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I))
                ends = find.search(html, at)
                at = ends.end() if ends else end
            elif name not in VOID and not (attributes.endswith("/") and name not in BLOCK):
                stack.push(node, name)

    def other(self, attributes: str, in_article: bool) -> int:
        """Whether the attributes tell of something other than the article: 3 that it is none by its role or is hidden, 2
        that a class or id names it, 1 that one hints at it, 0 not."""
        found = 0
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id"):
                parts = {x.lower() for x in NAME_PART.findall(value)}
                if not self.strict or (self.strict == 1 and parts & TEXT_NAMES):
                    continue
                if parts & NO_TEXT_NAMES or any(x.startswith(NO_TEXT_STARTS) for x in parts) or (parts & HEADER_NAMES and not parts & TEXT_NAMES and not in_article):
                    found = max(found, 1 if parts & WRAPPER_NAMES and len(parts) > 1 else 2)
                elif parts & HINTS:
                    found = max(found, 1)
            elif key == "role" and value.lower() in NO_TEXT_ROLES:
                return 3
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return 3
        return found

    def counts(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """Characters, link characters, tags and link tags below each node; a hinted or named node's characters weigh less."""
        n = len(self.tag)
        chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, _, text in self.segments:
            size = len(text.strip())
            chars[node] += size
            if self.linked[node]:
                link_chars[node] += size
        for k in range(n - 1, 0, -1):
            if self.dead[k]:
                continue
            up = self.parent[k]
            if self.hinted[k] or self.named[k]:
                chars[k] *= self.weight(k)
                link_chars[k] *= self.weight(k)
            chars[up] += chars[k]
            link_chars[up] += link_chars[k]
            tags[up] += tags[k] + 1
            link_tags[up] += link_tags[k] + (self.tag[k] in LINKS)
        return chars, link_chars, tags, link_tags

    def weight(self, k: int) -> float:
        return NAME_WEIGHT if self.named[k] else HINT_WEIGHT if self.hinted[k] else 1.0

    def densities(self, counted=None) -> tuple[list[float], list[float]]:
        """Composite density of each node, and the sum of its children's."""
        n = len(self.tag)
        chars, link_chars, tags, link_tags = counted or self.counts()
        density, total = [0.0] * n, [0.0] * n
        under = [1.0] * n  # below a named node everything weighs as little
        for k in range(1, n):
            under[k] = under[self.parent[k]] * (NAME_WEIGHT if self.named[self.parent[k]] else 1.0)
        share = link_chars[0] / max(1, chars[0])
        for k in range(n - 1, -1, -1):
            c, lc, t, lt = chars[k], link_chars[k], max(1, tags[k]), max(1, link_tags[k])
            if c and not self.dead[k]:
                base = max(math.e, math.log(c / max(1, c - lc) * lc + share * c + math.e))  # where links abound, they weigh more
                density[k] = c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(base)
                density[k] *= under[k]
                total[k] *= self.weight(k)
            if k and not self.dead[k]:
                total[self.parent[k]] += density[k]
        return density, total

    def selected(self) -> list[bool]:
        """Whether the text of each node is the article's."""
        n, counted = len(self.tag), self.counts()
        chars, link_chars, _, link_tags = counted
        density, total = self.densities(counted)
        best = list(range(n))  # node of the greatest sum in each subtree
        for k in range(n - 1, 0, -1):
            if not self.dead[k] and total[best[k]] > total[best[self.parent[k]]]:
                best[self.parent[k]] = best[k]
        core = best[0]
        path, up = set(), core
        while up >= 0:
            path.add(up)
            up = self.parent[up]
        threshold = min(density[k] for k in path)
        reach = [density[k] >= threshold and density[k] > 0 and not self.dead[k] for k in range(n)]
        around = [k for k in path if self.tag[k] in ARTICLE]
        marked = [False] * n
        if around:
            articles = [k for k in around if self.tag[k] == "article"]
            marked[min(articles or around)] = True  # a parent has the smaller number
            for k in range(min(around), n):  # other articles of the same main
                if self.tag[k] == "article" and reach[k] and chars[k] >= HINT_SHARE * chars[core] and self.in_article[self.parent[k]] and not self.is_list(chars[k], link_chars[k], link_tags[k]):
                    marked[k] = True
        else:
            for k in range(n):
                if reach[k]:
                    marked[best[k]] = True
        for k in range(n):
            if k in path:
                continue
            if self.named[k] and density[k] <= NAME_SHARE * total[self.parent[k]]:
                self.dead[k] = True
            if self.hinted[k] and not (reach[k] and chars[k] >= HINT_WEIGHT * HINT_SHARE * chars[core]) or self.tag[k] in LISTS and self.is_list(chars[k], link_chars[k], link_tags[k]):
                self.dead[k] = True
        for k in range(1, n):  # a node follows its parent
            self.dead[k] = self.dead[k] or self.dead[self.parent[k]]
            marked[k] = (marked[k] or marked[self.parent[k]]) and not self.dead[k]
        return marked

    @staticmethod
    def is_list(chars: int, link_chars: int, links: int) -> bool:
        return links >= LINK_LIST and link_chars >= LINK_SHARE * chars and link_chars <= LINK_CHARS * links

    def text(self) -> str:
        if not self.segments:
            return ""
        marked = self.selected()
        out: list[str] = []
        parts: list[str] = []
        last = -1
        for node, block, text in self.segments:
            if not marked[node]:
                continue
            if block != last:
                if line := " ".join("".join(parts).split()):
                    out.append(line)
                parts, last = [], block
            parts.append(text)
        if line := " ".join("".join(parts).split()):
            out.append(line)
        return "\n".join(out)


def main_text(html: str | None) -> str:
    """The page's text. Where names of classes and ids would leave nothing (a wrapper named after its side bar, say), they
    are heeded less."""
    for strict in (2, 1, 0):
        if text := Page(html, strict).text() if html else "":
            return text
    return ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars. pages: page_id, url, html."""
    session.prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(session.read(spark, sf_dir, "pages"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
ORACLE_SQL: dict[str, str] = {}
