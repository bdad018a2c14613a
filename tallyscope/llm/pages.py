"""Main text of web pages by nearest-URL page differencing.

A page is read as lines: runs of text between block-level tags. The pages of a host are put in the order of their URL
paths, each page is paired with the neighbour of the longer common path, their lines are aligned by longest common
subsequence, and the lines that both share are deleted as furniture of the site.

Two rules bound what the difference may decide. Furniture that differs from page to page survives it, so lines inside
elements that never hold an article (scripts, styles, navigation, page headers and footers, asides, forms, adverts,
notices, reader comments, by tag, role, class or id) are deleted as well, and if the page marks its article (article or
main), so is all outside. And an article that is copied or quoted elsewhere is shared but no furniture, so lines inside
a marked article stay. If nothing is left of a page without a marked article (a page next to its copy), the page keeps
the lines that are not furniture.

Finding the neighbours needs an order per host but no host in one task: rows are dealt by ranges of (host, path, page)
between cut points taken from the table, and each range gets a copy of the last row before and the first row after it.
Only the hashes of lines are compared; the text is read again with the places to delete.

Null and empty html give empty text; a null url is a host and path of its own; repeated rows are extracted each and are
each other's neighbours. Character references are decoded, white space inside a block becomes one blank, and blocks are
joined by one blank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import mapped, octets, pick
from tallyscope.session import cut

RANGES = 256
SAMPLE_PER_RANGE = 16

# Element names of the HTML standard, by how they are read here.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby",
    "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
FURNITURE = {
    "nav", "aside", "footer", "form", "script", "style", "noscript", "template", "button", "select", "option", "textarea", "input", "iframe", "object", "embed",
    "svg", "canvas", "dialog", "menu", "head", "title", "noembed", "noframes", "applet", "audio", "video", "map", "datalist",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist"}
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation",
    "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "header", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "notice", "notices",
    "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment",
    "comments", "disqus", "reply", "replies", "respond", "widget", "pagination", "pager", "search", "form", "skip", "gdpr", "paywall", "alert", "tags", "toc",
}
TITLES = {"header", "banner", "masthead", "tags"}  # hold the title or subject inside an article
# Words at the end of a class that say where or how something stands, not what it is.
PLACES = {"left", "right", "top", "bottom", "main", "inner", "outer", "wrap", "wrapper", "container", "box", "bar", "block", "area", "section", "panel", "list", "item", "items", "links", "buttons", "text", "content", "inline", "unit"}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul",
}

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BLANKS = re.compile(r"\s+")
NAMES = re.compile(r"[a-z]+")
WITHOUT = re.compile(r"\b(?:has|with|no|without|js|is)[-_][a-z_-]+")  # says what a page has, not what the element is


def says_furniture(token: str) -> bool:
    """Whether a class says that its element is furniture: its last word does, behind which only places stand. A
    ``notice-period`` is a period and ``search-results`` are results, a ``cookie-notice-box`` is a notice."""
    parts = NAMES.findall(WITHOUT.sub(" ", token))
    while len(parts) > 1 and parts[-1] in PLACES:
        parts.pop()
    return bool(parts) and parts[-1] in WORDS - TITLES


def is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    if name in FURNITURE or (name == "header" and not in_article):
        return True
    if not attributes.strip() or name in ("html", "body", "article", "main"):
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id"):
            if in_article:
                if any(map(says_furniture, value.split())):
                    return True
            elif set(NAMES.findall(WITHOUT.sub(" ", value))) & WORDS:
                return True
        if key == "role" and value in ROLES or key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(html: str) -> list[tuple[str, bool, bool]]:
    """(text, in furniture, in a marked article) of every block with text, in page order."""
    out: list[tuple[str, bool, bool]] = []
    open_: list[tuple[str, bool, bool]] = []  # element, furniture so far, article so far
    text: list[str] = []
    at = 0

    def close_block() -> None:
        if text:
            words = BLANKS.sub(" ", unescape("".join(text))).strip()
            text.clear()
            if words:
                out.append((words, open_[-1][1] if open_ else False, open_[-1][2] if open_ else False))

    while at < len(html):
        m = TOKEN.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        text.append(html[at : m.start()])
        at = m.end()
        closing, opening = m[1], m[2]
        if opening:
            name = opening.lower()
            attributes = m[3] or ""
            if name not in INLINE:
                close_block()
            if name in CLOSES_P and any(e[0] == "p" for e in open_):
                # A new block ends an open paragraph, and with it what was opened inside.
                k = max(i for i, e in enumerate(open_) if e[0] == "p")
                if all(e[0] in INLINE for e in open_[k + 1 :]):
                    del open_[k:]
            elif name in ("li", "tr", "td", "th", "dt", "dd", "option") and open_ and open_[-1][0] == name:
                open_.pop()
            if name in RAW:
                # Raw text ends at its own closing tag only.
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
                at = end.start() if end else len(html)
                continue
            if name in VOID or attributes.rstrip().endswith("/"):
                continue
            furniture, article = (open_[-1][1], open_[-1][2]) if open_ else (False, False)
            article = article or name in ("article", "main")
            open_.append((name, furniture or is_furniture(name, attributes, article), article))
        elif closing:
            name = closing.lower()
            if name not in INLINE:
                close_block()
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    break
    close_block()
    return out


def marked(found: list[tuple[str, bool, bool]]) -> bool:
    return any(article and not furniture for _, furniture, article in found)


def line_hashes(found: list[tuple[str, bool, bool]]) -> list[int]:
    return [xxhash.xxh64_intdigest(t) - (1 << 63) for t, _, _ in found]


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``. Lines that only one page has are left out first; the
    table of lengths is filled a row at a time."""
    there = set(b)
    mine = [i for i, x in enumerate(a) if x in there]
    here = set(a)
    x, y = np.array([a[i] for i in mine], np.int64), np.array([v for v in b if v in here], np.int64)
    if not len(x) or not len(y):
        return set()
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(1, len(x) + 1):
        take = best[i - 1, :-1] + (y == x[i - 1])
        best[i, 1:] = np.maximum.accumulate(np.maximum(best[i - 1, 1:], take))
    out, i, j = set(), len(x), len(y)
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            out.add(mine[i - 1])
            i, j = i - 1, j - 1
    return out


def main_text(html: str, shared: set[int]) -> str:
    """``shared``: places of the lines that the neighbour has too."""
    found = blocks(html)
    inside = marked(found)
    own = [t for i, (t, furniture, article) in enumerate(found) if not furniture and (article if inside else i not in shared)]
    return " ".join(own or (t for t, furniture, _ in found if not furniture))


def host_and_path(url: str | None) -> tuple[str, str]:
    if url is None:
        return "", ""
    try:
        parts = urlsplit(url.strip())
    except ValueError:
        return "", url
    return parts.netloc.lower(), parts.path


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def neighbours(keyed: DataFrame, ranges: int) -> DataFrame:
    """(host, path, row, lines) -> (row, shared): places of the lines that the nearest page by path has too."""
    # Cut points: the keys of the rows with the least hashes, evenly thinned. Their number does not grow with the table.
    sample = keyed.select("host", "path", "row").orderBy(F.xxhash64("row"), "row").limit(ranges * SAMPLE_PER_RANGE).collect()
    keys = sorted((r[0], r[1], r[2]) for r in sample)
    cuts = keys[SAMPLE_PER_RANGE::SAMPLE_PER_RANGE]
    shown = keyed.withColumn("key", F.struct("host", "path", "row"))
    if cuts:
        points = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(r).cast("bigint").alias("row")) for h, p, r in cuts))
        shown = shown.withColumn("range", F.size(F.filter(points, lambda c: c <= F.col("key"))))
    else:
        shown = shown.withColumn("range", F.lit(0))
    # At most two rows per range.
    edges = shown.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()
    edges.sort(key=lambda e: e["range"])
    ghosts = []
    for a, b in zip(edges, edges[1:]):
        ghosts += [(a["high"]["row"], b["range"]), (b["low"]["row"], a["range"])]
    every = shown.select("range", "host", "path", "row", "lines", F.lit(False).alias("ghost"))
    if ghosts:
        extra = keyed.sparkSession.createDataFrame(ghosts, "row bigint, to int")
        copies = shown.join(F.broadcast(extra), "row").select(F.col("to").alias("range"), "host", "path", "row", "lines", F.lit(True).alias("ghost"))
        every = every.unionByName(copies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []

        def solved(before: tuple | None, now: tuple, after: tuple | None) -> tuple | None:
            if now[5]:
                return None
            sides = [(common_prefix(now[2], s[2]), -k, s) for k, s in enumerate((before, after)) if s is not None and s[0] == now[0] and s[1] == now[1]]
            if not sides:
                return now[3], []
            return now[3], sorted(shared_lines(now[4], max(sides)[2][4]))

        for batch in batches:
            got = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                last.append(row)
                if len(last) == 2:
                    got.append(solved(None, last[0], last[1]))
                elif len(last) > 2:
                    got.append(solved(last[-3], last[-2], last[-1]))
                    last = last[-2:]
                    last.insert(0, last[0])
            got = [g for g in got if g]
            if got:
                yield packed(got)
        if last:
            end = solved(last[-2] if len(last) > 1 else None, last[-1], None)
            if end:
                yield packed([end])

    def packed(got: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int32()))], names=["row", "shared"])

    return every.repartition("range").sortWithinPartitions("range", "host", "path", "row", "ghost").mapInArrow(run, "row bigint, shared array<int>")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", ranges: int = RANGES) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    shown = pick(pages, page_id=page_id, url=url, html=html)
    shown = shown.withColumn("row", F.xxhash64("page_id", "url", "html"))

    def lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row, link, raw in zip(batch.column("row").to_pylist(), batch.column("url").to_pylist(), octets(batch.column("html"))):
            out.append((*host_and_path(link), row, line_hashes(blocks(raw.decode()))))
        kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["host", "path", "row", "lines"])

    keyed = cut(mapped(shown, lines, "host string, path string, row bigint, lines array<bigint>", "html"))
    shared = neighbours(keyed, ranges).where(F.size("shared") > 0).dropDuplicates(["row"])

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(raw.decode(), set(s or ())) for raw, s in zip(octets(batch.column("html")), batch.column("shared").to_pylist())]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])

    return mapped(shown.join(shared, "row", "left").select("page_id", "url", "html", "shared"), read, "page_id bigint, url string, text string, n_chars bigint", "html")
