"""Listing / detail extraction from stored pages (O.6 - O.11).

HTML parsing is the one place that needs Python: ``mapInPandas`` runs the
stdlib ``html.parser`` over Arrow batches of pages, emitting 0..n rows per
page.  Pages are partitioned by Spark; nothing is collected.  The selector
helper supports what the ordered selector lists use: tag, ``.class``,
``#id``, ``[attr]``, ``[attr*="v"]``, ``[attr="v"]``, descendants, commas.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# --- FIXED VALUES: ordered selector lists ----------------------------------
BILL_ROWS = ["table tbody tr", ".bill-item", ".bill-card", ".search-result", "[data-bill-id]", "article",
             ".legislation-item", ".datatable tbody tr", "tbody tr"]
BILL_TITLES = ["h2", "h3", ".title", ".bill-title", "a"]
NOTICE_LIST = [".notice-item", ".gazette-notice", ".notice-listing .notice", "article", ".search-result",
               'li a[href*="/notice/"]']
ANNOUNCEMENTS = ["article", ".view-content .views-row", ".release-list .release-item", ".speech-list .speech-item",
                 ".content-list .content-item", ".node-teaser", ".announcement", ".teaser", ".node"]
HEADING_LINKS = ["h1 a", "h2 a", "h3 a", ".title a", ".heading a"]
DATE_SELECTORS = ["time", ".date", ".published", ".timestamp", ".field-name-post-date", ".submitted", ".datetime",
                  ".publish-date", ".date-display-single"]
DATE_PATTERNS = [r"(\d{1,2}[\/\-]\d{1,2}[\/\-]\d{4})", r"(\d{4}[\/\-]\d{1,2}[\/\-]\d{1,2})",
                 r"(\d{1,2}\s+(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})"]
BILL_SUMMARY = [".summary", ".description", ".bill-summary", ".explanatory-note", 'meta[name="description"]', ".content p"]
STAGES = [".stage-history tr", ".timeline .stage", ".progress .step", ".stages li"]
VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}

ROW_SCHEMA = "page_id long, page_url string, pos int, title string, href string, date_text string, extra string"


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent", "texts")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent = tag, dict(attrs), parent
        self.children, self.texts = [], []

    def strings(self) -> list[str]:
        """Text nodes in document order (iterative: deep markup is fine)."""
        out, stack = [], [iter(self.texts)]
        while stack:
            item = next(stack[-1], None)
            if item is None:
                stack.pop()
            elif isinstance(item, str):
                out.append(item)
            else:
                stack.append(iter(item.texts))
        return out

    def text(self) -> str:
        return "".join(self.strings())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {}, None)
        self.cur = self.root

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, attrs, self.cur)
        self.cur.children.append(node)
        self.cur.texts.append(node)
        if tag not in VOID:
            self.cur = node

    def handle_endtag(self, tag):
        n = self.cur
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.cur = n.parent

    def handle_data(self, data):
        if self.cur.tag not in ("script", "style"):
            self.cur.texts.append(data)


def parse_html(html: str) -> _Node:
    b = _Builder()
    try:
        b.feed(html or "")
        b.close()
    except Exception:  # malformed markup: keep what was parsed
        pass
    return b.root


_SIMPLE = re.compile(r'([a-zA-Z0-9]+)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^$]?=)"([^"]*)")?\]|:(first-child|last-child)')


def _compile_simple(s: str):
    parts = []
    for m in _SIMPLE.finditer(s):
        parts.append(m.groups())
    return parts


def _match(node: _Node, parts) -> bool:
    for tag, cls, idv, attr, op, val, pseudo in parts:
        if tag and node.tag != tag.lower():
            return False
        if cls and cls not in (node.attrs.get("class") or "").split():
            return False
        if idv and node.attrs.get("id") != idv:
            return False
        if attr:
            v = node.attrs.get(attr)
            if v is None:
                return False
            if op == "*=" and val not in v:
                return False
            if op == "=" and v != val:
                return False
        if pseudo:
            siblings = node.parent.children if node.parent is not None else [node]
            if node is not (siblings[0] if pseudo == "first-child" else siblings[-1]):
                return False
    return True


def _descendants(node: _Node):
    for c in node.children:
        yield c
        yield from _descendants(c)


def select(root: _Node, selector: str) -> list[_Node]:
    """Elements matching a (comma-separated) descendant selector, document order."""
    found: list[_Node] = []
    seen = set()
    for alt in selector.split(","):
        steps = [_compile_simple(s) for s in alt.split()]
        current = [root]
        for step in steps:
            nxt, ids = [], set()
            for base in current:
                for d in _descendants(base):
                    if id(d) not in ids and _match(d, step):
                        ids.add(id(d))
                        nxt.append(d)
            current = nxt
        for n in current:
            if id(n) not in seen:
                seen.add(id(n))
                found.append(n)
    order = {id(n): i for i, n in enumerate(_descendants(root))}
    return sorted(found, key=lambda n: order[id(n)])


def select_one(root: _Node, selector: str):
    got = select(root, selector)
    return got[0] if got else None


def text_of(node: _Node | None, strip: bool = True) -> str:
    """Element text; ``strip`` strips every text node and joins them with no
    separator (the ``get_text(strip=True)`` behaviour the extraction rules
    assume)."""
    if node is None:
        return ""
    if not strip:
        return node.text()
    return "".join(t.strip() for t in node.strings() if t.strip())


def _absolute(base: str, href: str) -> str:
    from urllib.parse import urljoin
    return href if href.startswith("http") else urljoin(base or "", href)


def _first_elements(root, selectors):
    for sel in selectors:
        got = select(root, sel)
        if got:
            return got
    return []


def _rows_announcements(page_id, url, root):
    rows = []
    for i, el in enumerate(_first_elements(root, ANNOUNCEMENTS)):
        link = None
        for sel in HEADING_LINKS:
            link = select_one(el, sel)
            if link is not None:
                break
        if link is None:
            link = el if el.tag == "a" else select_one(el, "a")
        title = text_of(link) if link is not None else text_of(select_one(el, "h1, h2, h3"))
        href = link.attrs.get("href", "") if link is not None else ""
        date = ""
        for sel in DATE_SELECTORS:
            d = select_one(el, sel)
            if d is not None:
                date = d.attrs.get("datetime") or text_of(d)
                if date:
                    break
        if not date:
            body = text_of(el, strip=False)
            for p in DATE_PATTERNS:
                m = re.search(p, body, re.IGNORECASE)
                if m:
                    date = m.group(1)
                    break
        if title:
            rows.append((page_id, url, i, title, _absolute(url, href) if href else "", date, ""))
    return rows


def _rows_bills(page_id, url, root):
    rows = []
    for i, el in enumerate(_first_elements(root, BILL_ROWS)):
        cells = select(el, "td")
        title, href, sponsor, date = "", "", "", ""
        if len(cells) >= 2:
            a = select_one(cells[0], "a")
            title = text_of(a) if a is not None else text_of(cells[0])
            href = a.attrs.get("href", "") if a is not None else ""
            for c in cells[1:4]:
                t = text_of(c)
                if len(t) > 2 and not t.isdigit() and not re.search(r"\d{4}", t):
                    sponsor = t
                    break
            last = text_of(cells[-1])
            if re.search(r"\d{4}", last):
                date = last
        else:
            for sel in BILL_TITLES:
                t = select_one(el, sel)
                if t is not None:
                    title = text_of(t)
                    if t.tag == "a":
                        href = t.attrs.get("href", "")
                    break
            if not href:
                a = select_one(el, "a")
                href = a.attrs.get("href", "") if a is not None else ""
        if title and href:
            rows.append((page_id, url, i, title, _absolute(url, href), date, sponsor))
    return rows


def _rows_notices(page_id, url, root):
    rows = []
    for i, a in enumerate(select(root, 'a[href*="/notice/id/"]')):
        row = a.parent
        while row is not None and row.tag != "tr":
            row = row.parent
        if row is None:  # S.15: a link outside a table row is dropped
            continue
        cells = select(row, "td")
        date = text_of(cells[0]) if cells else ""
        ntype = text_of(cells[2]) if len(cells) > 2 else ""
        rows.append((page_id, url, i, text_of(a), _absolute(url, a.attrs.get("href", "")), date, ntype))
    return rows


def _rows_notice_list(page_id, url, root):
    rows = []
    for i, el in enumerate(_first_elements(root, NOTICE_LIST)):
        a = el if el.tag == "a" else select_one(el, "a")
        title = text_of(a) if a is not None else text_of(el)
        href = a.attrs.get("href", "") if a is not None else ""
        d = select_one(el, ".date, .notice-date, time")
        if title and href:
            rows.append((page_id, url, i, title, _absolute(url, href), text_of(d), ""))
    return rows


def _rows_bill_detail(page_id, url, root):
    summary = ""
    for sel in BILL_SUMMARY:
        el = select_one(root, sel)
        if el is None:
            continue
        if sel.startswith("meta"):
            summary = el.attrs.get("content", "")
            break
        t = text_of(el)
        if len(t) > 50:
            summary = t
            break
    stages = [text_of(s) for s in _first_elements(root, STAGES)]
    return [(page_id, url, 0, text_of(select_one(root, "title")), "", "", summary + ("\n" + "|".join(stages) if stages else ""))]


def _rows_announcement_detail(page_id, url, root):
    body = text_of(select_one(root, "article") or select_one(root, "main") or select_one(root, "body"))
    sentences = re.split(r"(?<=[.!?])\s+", body)
    summary = " ".join(sentences[:2]) if len(sentences) >= 2 else body[:300]
    date_el = select_one(root, "time")
    date = (date_el.attrs.get("datetime") or text_of(date_el)) if date_el is not None else ""
    return [(page_id, url, 0, text_of(select_one(root, "h1")), "", date, summary)]


STAGE_CELL = ".stage-name, .stage, th, td:first-child"
DATE_CELL = ".date, .stage-date, td:last-child"


def _rows_bill_stages(page_id, url, root):
    """One row per stage element: its text (title), the stage cell (extra)
    and the date cell (date_text); parsing and date checks run in Spark."""
    rows = []
    for i, el in enumerate(_first_elements(root, STAGES)):
        rows.append((page_id, url, i, text_of(el), "", text_of(select_one(el, DATE_CELL)),
                     text_of(select_one(el, STAGE_CELL))))
    return rows


_KINDS = {
    "bill_stages": _rows_bill_stages,
    "bill_rows": _rows_bills, "notice_rows": _rows_notices, "notice_list": _rows_notice_list,
    "announcement_rows": _rows_announcements, "bill_detail": _rows_bill_detail,
    "announcement_detail": _rows_announcement_detail,
}


def extract(pages: DataFrame, kind: str) -> DataFrame:
    """Run one extractor over a ``pages`` table (page_id, url, html)."""
    fn = _KINDS[kind]

    def run(batches):
        for pdf in batches:
            out = []
            for pid, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                out.extend(fn(int(pid), url, parse_html(html)))
            yield pd.DataFrame(out, columns=["page_id", "page_url", "pos", "title", "href", "date_text", "extra"])

    return pages.select("page_id", "url", "html").mapInPandas(run, ROW_SCHEMA)
