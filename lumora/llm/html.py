"""Main text of web pages, with site templates removed.

1. Each page's containers (divisions, lists, tables and the like), and its paragraphs outside the article, are hashed (tag,
   attributes and text as in the source) and counted per host in Spark, once for each distinct text of a page, so that copies
   of a page are one: one that recurs on at least TEMPLATE_PAGES texts and TEMPLATE_SHARE of a host's texts is part of its
   template. Counts are pre-aggregated, so a host may hold any share of the pages.
2. A page's text is what its articles say (else its main element, else its body) without template subtrees and
   without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments.
   Inside an article only such containers can be template, so no sentence of an article is lost for being repeated. Where
   they hold half of an article's (or main element's) text or more, they are its main text and stay.

Character references are decoded, white space in a block becomes one space, blocks are joined by an empty line.

In an article, an element goes by its class, id or role only if the name consists of words for such parts ("share", "ad-box").

Null or empty html gives an empty text. A null url is a host of its own. Repeated rows are each returned; they
count once. Broken html is read as browsers do for unclosed paragraphs and list items; other
unclosed elements end with their parent. A "<" behind which no ">" follows is text. Where a quote in a tag never closes, tags end
at their first ">" from there on. Reading a page takes time in proportion to its length, whatever it holds. Empty tables give empty results.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import by_bytes, staged

TEMPLATE_PAGES, TEMPLATE_SHARE = 10, 0.05

# Fixed values of html: kinds of elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template", "svg", "math"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
#: An opening of the key ends an open element of these, up to the boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
P_STOPS = {"button", "table", "td", "th", "div", "section", "article", "main", "body", "li", "blockquote"}
# What is no main text, by tag and by words in class, id and role.
DROP = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "object", "audio", "video", "canvas", "head"}
DROP_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "recommended", "related", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
CONTAINERS = {"div", "section", "nav", "aside", "header", "footer", "ul", "ol", "table", "form", "dl"}

#: Words that may stand beside them in a name inside an article, where a name has to consist of such words only.
BESIDE = {"area", "bar", "block", "box", "buttons", "container", "content", "item", "items", "links", "list", "section", "wrapper"}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _is_drop(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no main text. Inside an article or main element a name must say nothing else."""
    if tag in DROP:
        return True
    if not attributes:
        return False
    names = [n for m in _NAMED.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().split()]
    words = [[w for w in re.split(r"[^a-z0-9]+", n) if w] for n in names]
    if tag in ("body", "html", "article", "main"):
        return tag == "article" and any(w in ("comment", "comments") for own in words for w in own)
    if inside:
        return any(not DROP_NAMES.isdisjoint(own) and all(w in DROP_NAMES or w in BESIDE for w in own) for own in words)
    return any(w in DROP_NAMES for own in words for w in own)


_BASE, _PRIME = 0x1F3D5B79A2C4E687, (1 << 61) - 1


class Page:
    """One pass over a page, in time linear in its length: text runs with the elements that they stand in, and spans of elements."""

    def __init__(self, source: str):
        self.source = source
        self.tags: list[str] = ["#root"]  # by element
        self.up: list[int] = [0]
        self.drop: list[bool] = [False]
        self.span: list[list[int]] = [[0, 0]]  # in parts of the source: tags and text runs
        self.items: list[tuple[int, str | None]] = []  # (element, text), or (element, None) where a block begins or ends
        self.sums, self.powers = [0], [1]  # of hashes of the parts, so that a span's hash needs no second look at it
        self._read()

    def _part(self, text: str) -> None:
        words = " ".join(text.split())
        if words:
            self.sums.append((self.sums[-1] * _BASE + _hash(words)) % _PRIME)
            self.powers.append(self.powers[-1] * _BASE % _PRIME)

    def _tag_end(self, at: int) -> int:
        """The place behind a tag whose name ends at `at`, or -1. Where a quote never closes, quotes count no more from there on."""
        s, begin = self.source, at
        while self.quotes:
            m = _STOP.search(s, at)
            if not m:
                return -1
            if m[0] == ">":
                return m.end()
            at = s.find(m[0], m.end()) + 1
            if not at:
                self.quotes = False
        return s.find(">", begin) + 1 or -1

    def _read(self) -> None:
        s, stack, at, n = self.source, [0], 0, len(self.source)
        open_: dict[str, int] = {}
        main = 0  # open article and main elements
        self.quotes = True
        text_from = 0

        def text_to(end: int) -> None:
            if end > text_from:
                self.items.append((stack[-1], s[text_from:end]))
                self._part(s[text_from:end])

        def close_to(depth: int) -> None:
            nonlocal main
            while len(stack) > depth:
                e = stack.pop()
                self.span[e][1] = len(self.sums) - 1
                open_[self.tags[e]] -= 1
                main -= self.tags[e] in ("article", "main")
                if self.tags[e] in BLOCK:
                    self.items.append((stack[-1], None))

        while True:
            at = s.find("<", at)
            if at < 0:
                break
            if s.startswith("<!--", at):
                text_to(at)
                end = s.find("-->", at + 4)
                at = text_from = end + 3 if end >= 0 else n
                continue
            if s.startswith(("<!", "<?"), at):
                end = s.find(">", at)
                if end < 0:
                    break
                text_to(at)
                at = text_from = end + 1
                continue
            m = _TAG.match(s, at)
            if not m:
                at += 1
                continue
            end = self._tag_end(m.end())
            if end < 0:  # no tag ends behind this one: the rest is text
                break
            text_to(at)
            begin, at = at, end
            text_from = end
            tag, attributes = m[2].lower(), s[m.end() : end - 1]
            if m[1]:
                self._part(s[begin:end])
                if open_.get(tag):
                    d = next(d for d in range(len(stack) - 1, 0, -1) if self.tags[stack[d]] == tag)
                    close_to(d)
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(s, end)
                at = text_from = close.end() if close else n
                self._part(s[begin:at])
                continue
            if tag == "br":
                self._part("<br>")
                self.items.append((stack[-1], " "))
                continue
            if tag in VOID:
                self._part(s[begin:end])
                if tag in BLOCK:
                    self.items.append((stack[-1], None))
                continue
            if tag in CLOSES or tag in BLOCK:
                ends, stops = CLOSES.get(tag, ({"p"}, P_STOPS))
                if any(open_.get(t) for t in ends):
                    for d in range(len(stack) - 1, 0, -1):
                        t = self.tags[stack[d]]
                        if t in ends:
                            close_to(d)
                            break
                        if t in stops:
                            break
            e = len(self.tags)
            self.tags.append(tag)
            self.up.append(stack[-1])
            self.drop.append(_is_drop(tag, attributes, main > 0))
            self.span.append([len(self.sums) - 1, len(self.sums)])
            self._part(s[begin:end])
            if not attributes.rstrip().endswith("/") or tag in BLOCK:
                stack.append(e)
                open_[tag] = open_.get(tag, 0) + 1
                main += tag in ("article", "main")
            if tag in BLOCK:
                self.items.append((stack[-1], None))
        text_to(n)
        close_to(1)

    def _root(self) -> str:
        have = {t for t, d in zip(self.tags, self.drop, strict=True) if not d}
        return next((t for t in ("article", "main") if t in have), "#root")

    def _mostly(self, known: list[bool], inside: list[bool], gone: list[bool]) -> bool:
        """Whether the known elements hold half of the main text or more."""
        own = [(e, len("".join(t.split()))) for e, t in self.items if t is not None and inside[e] and not gone[e]]
        return 2 * sum(n for e, n in own if known[e]) >= sum(n for _, n in own)

    def inside(self) -> list[bool]:
        """By element, whether it is in the page's article, or main element, or else its body."""
        root = self._root()
        out: list[bool] = []
        for e, t in enumerate(self.tags):
            out.append((t == root and not self.drop[e]) or (e > 0 and out[self.up[e]]))
        return out

    def subtrees(self) -> dict[int, int]:
        """Hash of each element that can be part of a template."""
        inside, found = self.inside(), {}
        for e, t in enumerate(self.tags):
            if t in CONTAINERS or (t == "p" and not inside[e]):
                a, b = self.span[e]
                found[e] = (self.sums[b] - self.sums[a] * self.powers[b - a]) % _PRIME
        return found

    def text(self, template: set[int]) -> str:
        inside = self.inside()
        gone = [False] * len(self.tags)
        known = [False] * len(self.tags)
        hashes = self.subtrees() if template else {}
        for e in range(1, len(self.tags)):
            head = self.tags[e] == "header" and not inside[self.up[e]]
            gone[e] = gone[self.up[e]] or self.drop[e] or head
            known[e] = known[self.up[e]] or hashes.get(e) in template
        if any(known) and (self._root() == "#root" or not self._mostly(known, inside, gone)):
            gone = [g or k for g, k in zip(gone, known, strict=True)]
        blocks, now = [], []
        for e, t in self.items:
            if t is None:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif inside[e] and not gone[e]:
                now.append(t)
        if now:
            blocks.append("".join(now))
        cleaned = (" ".join((_html.unescape(b) if "&" in b else b).split()) for b in blocks)
        return "\n\n".join(b for b in cleaned if b)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "html", 8 << 20):
        hosts, contents, hashes = [], [], []
        for h, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(source or "")
            own = [None, *set(page.subtrees().values())]  # null stands for the page
            hosts += [h] * len(own)
            contents += [_hash(page.text(set()))] * len(own)
            hashes += own
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(hashes, pa.int64())], ["host", "content", "hash"])


def templates(pages: DataFrame, least: int = TEMPLATE_PAGES, share: float = TEMPLATE_SHARE) -> DataFrame:
    """host and the sorted hashes of its template subtrees."""
    own = pages.select(host(F.col("url")).alias("host"), "html")
    each = own.mapInArrow(_subtrees, "host string, content long, hash long").distinct()
    # a host of fewer texts than `least` has no template, so its total is not needed either
    counts = staged(each.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "subtrees")
    total = counts.where("hash is null").select("host", F.col("n").alias("texts"))
    found = counts.where("hash is not null").join(total, "host").where(F.col("n") >= share * F.col("texts"))
    return found.groupBy("host").agg(F.sort_array(F.collect_set("hash")).alias("template"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "html", 8 << 20):
        rows = zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True)
        texts = [Page(source).text(set(t or ())) if source else "" for source, t in rows]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, least: int = TEMPLATE_PAGES, share: float = TEMPLATE_SHARE) -> DataFrame:
    """page_id, url and text of each row of pages."""
    # Spark broadcasts the written table if it is small, and else joins by host, splitting large hosts
    found = staged(templates(pages, least, share), "templates")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host(F.col("url")))
    return rows.join(found, "host", "left").select("page_id", "url", "html", "template").mapInArrow(_texts, "page_id long, url string, text string")
