"""Main text of HTML pages.

A page is cut into blocks (text between block-level tags and line breaks),
and each block lies in a zone: ``main`` inside article or main elements,
``chrome`` inside menus, headers, footers, sidebars, forms, adverts, notices
and comments (by element or by the whole values of class, id and role), else
``open``.  Scripts, styles, markup and the head are no blocks.  An element
that is chrome by its values alone is none if it holds the page's articles:
of the article and main elements outside other chrome and each other, those
in the fewest such elements free them.

Open blocks are judged by the suffix array of their host: the token streams
of all pages' blocks outside ``main`` are concatenated, and a run of
``RUN`` tokens or more that occurs in several pages of the host is
repeated.  Pages are several if they differ in page_id and in their blocks, so
rows of one page and copies of its payload repeat nothing.  Such runs are
the intervals of the suffix array in which suffixes agree in RUN tokens; the
intervals are found by grouping the suffixes by those tokens, which
pre-aggregates in each task, where sorting would bring one common footer of a
large host to one task.  Of an open block, repeated runs are removed that
cover it wholly or are of ``LONG`` tokens at least; shorter ones are phrases of
its text.  Where that is more than half of the open text of a page without
``main``, the page is a copy: there, runs of the more pages are removed first, and
what would take more than half stays.  Text in ``main`` is never removed:
articles are copied between pages of a host, too.

Defined results: a null html is an empty page; a tag that the end of the page
cuts off is no text; a page without a url has the host ''; rows with equal
page_id are pages of their own; a page without text has an empty one.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.llm.common import stored, table, task_segments

#: Tokens that a repeated run has at least.
RUN = 8
#: Tokens of a repeated run that is removed from inside a block.
LONG = 40

# Elements of HTML by their part in the layout, and words in class, id or role of boilerplate.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "svg", "math"}
_MAIN = {"article", "main"}
_CHROME = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "object", "canvas", "head"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "button", "caption", "center", "dd", "details", "dialog", "dir",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CLOSED_BY_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
_VALUES = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "footer", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo",
    "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "subscription", "widget",
    "ad-banner", "ad-box", "ad-container", "ad-slot", "ad-unit", "ad-wrapper", "breadcrumb-nav", "comment-body", "comment-form",
    "comment-list", "comment-respond", "comments-area", "comments-list", "comments-section", "cookie-banner", "cookie-bar",
    "cookie-consent", "cookie-notice", "cookie-popup", "footer-links", "footer-menu", "footer-nav", "footer-widgets", "header-nav",
    "left-sidebar", "main-menu", "main-nav", "main-navigation", "mobile-menu", "mobile-nav", "nav-bar", "nav-links", "nav-menu",
    "newsletter-form", "newsletter-signup", "page-footer", "post-navigation", "primary-menu", "primary-nav", "related-articles",
    "related-links", "related-posts", "related-stories", "right-sidebar", "share-bar", "share-buttons", "share-links",
    "sidebar-left", "sidebar-right", "sidebar-widget", "site-footer", "site-menu", "site-nav", "site-navigation", "social-icons",
    "social-links", "social-media", "social-share", "sponsored-content", "subscribe-form", "top-menu", "top-nav", "widget-area"}
_PLAIN = {"html", "body", "main"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|</?[a-zA-Z][^\s/>]*[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>"""
    r"|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ROLE_MAIN = re.compile(r"""\srole\s*=\s*["']?main["'\s/>]""", re.I)
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"

_PAGE_DDL = "key long, page_id long, url string, host string, blocks array<struct<zone:string,text:string>>"
_BLOCKS = pa.list_(pa.struct([("zone", pa.string()), ("text", pa.string())]))


def _is_boilerplate(name: str, tag: str) -> bool:
    if name in _PLAIN or "=" not in tag:
        return False
    for found in _MARKS.findall(tag):
        if not _VALUES.isdisjoint("".join(found).lower().replace("_", "-").split()):
            return True
    return False


def blocks(page: str) -> list[tuple[str, str]]:
    """The blocks of a page as (zone, text), in page order."""
    out: list[tuple[str, tuple[int, ...], str]] = []  # zone without wrappers, wrappers, text
    pieces: list[str] = []
    # open elements: name, zone inside, and the elements around that are chrome by their values alone
    stack: list[tuple[str, tuple[str, tuple[int, ...]]]] = []
    outside = ("open", ())
    zone, at = outside, 0
    articles: list[tuple[int, ...]] = []  # the wrappers of each article or main element outside chrome and main

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            out.append((*zone, text))
        pieces.clear()

    def zoned() -> list[tuple[str, str]]:
        fewest = min(map(len, articles), default=0)
        freed = {w for own in articles if len(own) == fewest for w in own}
        return [("chrome" if not freed.issuperset(wrappers) else z, text) for z, wrappers, text in out]

    while True:
        token = _TOKEN.search(page, at)
        stop = token.start() if token else len(page)
        if stop > at:
            text = page[at:stop]
            pieces.append(entities.unescape(text) if "&" in text else text)
        if not token:
            flush()
            return zoned()
        at = token.end()
        tag = token.group()
        if tag[1] in "!?":
            continue
        name = _NAME.match(tag)[1].lower()
        if not tag.endswith(">"):
            continue  # cut off by the end of the page
        if tag[1] == "/":
            if name in _BLOCK:
                flush()
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
                inside = stack[-1][1] if stack else outside
                if inside != zone:
                    flush()
                    zone = inside
            continue
        if name in _RAW:
            if not tag.endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in _BLOCK:
            flush()
            if stack and stack[-1][0] in _CLOSED_BY_BLOCKS:
                stack.pop()
        outer = inner = stack[-1][1] if stack else outside
        if inner[0] != "chrome":
            is_main = name in _MAIN or _ROLE_MAIN.search(tag) is not None
            # an article's own values count inside such an element alone, where comments are articles, too
            marked = _is_boilerplate(name, tag) and (name != "article" or bool(inner[1]))
            if name in _CHROME or (name == "header" and inner[0] != "main"):
                inner = ("chrome", inner[1])
            elif marked and (name == "article" or inner[0] == "main"):
                inner = ("chrome", inner[1])
            elif marked and not is_main:
                inner = (inner[0], (*inner[1], at))
            elif is_main and inner[0] == "open":
                inner = ("main", inner[1])
                articles.append(inner[1])
        if name in _EMPTY or tag.endswith("/>") or (name not in _BLOCK and inner == outer):
            continue
        if inner != zone:
            flush()
        stack.append((name, inner))
        zone = inner


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = task_segments()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            found = [[{"zone": z, "text": t} for z, t in blocks(h or "")] for h in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([next(numbers) for _ in found], pa.int64()), *part.columns[:3], pa.array(found, _BLOCKS)],
                names=["key", "page_id", "url", "host", "blocks"])


def page_blocks(pages: DataFrame) -> DataFrame:
    """Pages (key, page_id, url, host, blocks); stored."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), _HOST, 1)).alias("host"),
                        F.col("html").cast("string"))
    return stored(rows.mapInArrow(_parsed, _PAGE_DDL), "page-blocks")


def repeated_runs(parsed: DataFrame, run: int = RUN) -> DataFrame:
    """Per page (key): starts, the places in its token stream outside main where a run begins that several pages
    of the host have, in the lower 32 bits; above them how often the host has that run."""
    outside = F.filter("blocks", lambda b: b["zone"] != "main")
    stream = F.split(F.array_join(F.transform(outside, lambda b: b["text"]), " "), " ")
    payload = F.xxhash64("blocks")
    streams = parsed.where(F.size(outside) > 0).select(
        "key", "host", F.coalesce("page_id", payload).alias("page"), F.hash(payload).alias("payload"), stream.alias("tokens")).where(
        F.size("tokens") >= run)
    own = ["key", "host", "page", "payload"]
    suffixes = streams.select(*own, "tokens", F.explode(F.sequence(F.lit(1), F.size("tokens") - run + 1)).alias("at")).select(
        *own, "at", F.xxhash64(F.array_join(F.slice("tokens", F.col("at"), F.lit(run)), " ")).alias("head"))
    # two pages that differ in both are there if and only if several values of each are
    intervals = suffixes.groupBy("host", "head").agg(
        F.count("*").alias("n"), F.min("page").alias("a"), F.max("page").alias("b"), F.min("payload").alias("c"),
        F.max("payload").alias("d")).where("a <> b AND c <> d")
    start = F.shiftleft(F.least("n", F.lit((1 << 31) - 1)), 32).bitwiseOR((F.col("at") - 1).cast("long"))
    return suffixes.select("key", "host", "head", "at").join(intervals.select("host", "head", "n"), ["host", "head"]).groupBy("key").agg(
        F.collect_list(start).alias("starts"))


def _removed(found: list[dict], starts: list[int], run: int, bar: int) -> list[set[int]]:
    """Per open block of a page, the places in it that runs of at least ``bar`` occurrences remove."""
    covered = {(s & 0xFFFFFFFF) + j for s in starts if s >> 32 >= bar for j in range(run)}
    out, at = [], 0
    for block in found:
        if block["zone"] == "main":
            continue
        n = block["text"].count(" ") + 1
        if block["zone"] == "open":
            gone: set[int] = set()
            first = 0
            for k in range(n + 1):
                if k < n and at + k in covered:
                    continue
                if k - first >= LONG or k - first == n:
                    gone.update(range(first, k))
                first = k + 1
            out.append(gone)
        at += n
    return out


def _unique(run: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for found, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                starts = starts or []
                gone = _removed(found, starts, run, 0)
                if not any(b["zone"] == "main" for b in found):
                    half = sum(b["text"].count(" ") + 1 for b in found if b["zone"] == "open") / 2
                    if sum(map(len, gone)) > half:
                        # the least bar that leaves half of the page's open text
                        bars = sorted({s >> 32 for s in starts})
                        low, high = 1, len(bars)
                        while low < high:
                            mid = (low + high) // 2
                            if sum(map(len, _removed(found, starts, run, bars[mid]))) > half:
                                low = mid + 1
                            else:
                                high = mid
                        gone = _removed(found, starts, run, bars[low] if low < len(bars) else 1 << 31)
                lines, opened = [], iter(gone)
                for block in found:
                    if block["zone"] == "main":
                        lines.append(block["text"])
                    elif block["zone"] == "open":
                        own = next(opened)
                        left = " ".join(t for k, t in enumerate(block["text"].split(" ")) if k not in own)
                        if left:
                            lines.append(left)
                texts.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return work


def main_text(pages: DataFrame, run: int = RUN) -> DataFrame:
    """Per page of ``pages`` (page_id, url, html): page_id, url, text."""
    parsed = page_blocks(pages)
    is_open = F.exists("blocks", lambda b: b["zone"] == "open")
    main = F.transform(F.filter("blocks", lambda b: b["zone"] == "main"), lambda b: b["text"])
    decided = parsed.where(~is_open).select("page_id", "url", F.array_join(main, "\n").alias("text"))
    judged = parsed.where(is_open).join(repeated_runs(parsed, run), "key", "left").select("page_id", "url", "blocks", "starts")
    return decided.unionByName(judged.mapInArrow(_unique(run), "page_id long, url string, text string"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
