"""Product containers of a listing page (E4): the one batch step that needs a
real HTML tree (selectors match nested elements, which regexes cannot).

It runs as ``mapInPandas``: Spark partitions the pages, each task parses its
pages with the standard-library HTML parser and emits one row per container
(page_id, pos, texts[], hrefs[], srcs[]). Everything after that -- text clean-up,
link/image choice, title/price rules -- is Column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Container selector cascade per site, in order; the first
# selector with any match wins. Then the per-site fallback.
SELECTORS = {
    "jiji": ['div[class*="masonry-item"]'],
    "jumia": ['article.prd', '.prd', 'div.prd', 'article[class*="prd"]', 'div[class*="product"]',
              'div[class*="item"]'],
    "tonaton": ['.product__container', '.listing-item', '.ad-listing', '[data-testid="listing-item"]',
                '.product-item'],
    "aliexpress": ['div[data-widget-cid*="hy_bn"]', 'div[class*="search-item-card-wrapper-gallery"]',
                   'div[class*="kt_jy"]', 'div[class*="list-item"]', 'div[class*="gallery-item"]',
                   'div[class*="item-wrap"]', 'div[class*="item-container"]', 'article[class*="prd"]',
                   'div[class*="prd"]', 'article.prd_fb', 'div[data-spm-anchor-id]', 'div[class*="product"]',
                   'div[class*="item"]', 'div[class*="card"]', 'article'],
}
# fallback: jiji -> 'div[class*="item"]'; jumia/tonaton -> every div; aliexpress -> divs with > 50 text chars
FALLBACK = {"jiji": ("select", 'div[class*="item"]'), "jumia": ("divs", 0), "tonaton": ("divs", 0),
            "aliexpress": ("divs", 50)}
NOISE_TAGS = {"script", "style", "noscript"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
             "track", "wbr"}

CONTAINER_SCHEMA = ("page_id long, site_key string, url string, pos int, texts array<string>, "
                    "hrefs array<string>, srcs array<string>, error string")

_SEL = re.compile(r'^(?P<tag>[a-z0-9]+)?(?:\.(?P<cls>[\w-]+))?'
                  r'(?:\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)"(?P<val>[^"]*)")?\])?$')


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent", "classes")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        self.classes = attrs["class"].split() if "class" in attrs else ()


class _Tree(HTMLParser):
    """Element tree; unknown end tags are ignored, open tags close with their ancestor."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {}, None)
        self.cur = self.root

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: (v or "") for k, v in attrs}, self.cur)
        self.cur.children.append(node)
        if tag not in VOID_TAGS:
            self.cur = node

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(_Node(tag, {k: (v or "") for k, v in attrs}, self.cur))

    def handle_endtag(self, tag):
        n = self.cur
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


class Cascade:
    """A list of selectors compiled once into an index by tag: one walk over a tree's elements finds
    those of the first selector that matches any."""

    def __init__(self, selectors: list[str]):
        self.size = len(selectors)
        self.by_tag: dict[str | None, list[tuple]] = {}
        for i, sel in enumerate(selectors):
            m = _SEL.match(sel)
            if m is None:
                raise ValueError(f"not a selector of this kind: {sel}")
            self.by_tag.setdefault(m["tag"], []).append((i, m["cls"], m["attr"], m["op"], m["val"]))
        any_tag = self.by_tag.pop(None, [])
        self.by_tag = {t: sorted(x + any_tag, key=lambda r: r[0]) for t, x in self.by_tag.items()}
        self.any_tag = any_tag

    def select(self, elements: list[_Node]) -> list[_Node]:
        best, hits = self.size, []
        for e in elements:
            for i, cls, attr, op, val in self.by_tag.get(e.tag, self.any_tag):
                if i > best:
                    break
                if cls and cls not in e.classes:
                    continue
                if attr:
                    have = e.attrs.get(attr)
                    if have is None or op == "*=" and val not in have or op == "=" and val != have:
                        continue
                if i < best:
                    best, hits = i, []
                hits.append(e)
                break
        return hits


def _elements(root: _Node):
    """Elements in document order (noise subtrees skipped)."""
    stack = [root]
    while stack:
        n = stack.pop()
        if n is not root:
            yield n
        stack.extend(c for c in reversed(n.children) if isinstance(c, _Node) and c.tag not in NOISE_TAGS)


def _texts(n: _Node) -> list[str]:
    out, stack = [], [n]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            s = x.strip()
            if s:
                out.append(s)
        elif x.tag not in NOISE_TAGS:
            stack.extend(reversed(x.children))
    return out


def _attr_values(n: _Node, tag: str, attr: str) -> list[str]:
    return [e.attrs[attr] for e in _elements(n) if e.tag == tag and e.attrs.get(attr)]


_CASCADES = {site: Cascade(sels) for site, sels in SELECTORS.items()}
_FALLBACKS = {site: Cascade([arg] if kind == "select" else ["div"]) for site, (kind, arg) in FALLBACK.items()}
_DIVS = Cascade(["div"])


def find_containers(html: str, site_key: str, n: int | None = None) -> list[_Node]:
    """The containers of a page (the first ``n``, if given) under the site's selector cascade."""
    p = _Tree()
    p.feed(html or "")
    p.close()
    els = list(_elements(p.root))
    hit = _CASCADES[site_key].select(els) if site_key in _CASCADES else []
    if not hit:
        hit = _FALLBACKS.get(site_key, _DIVS).select(els)
        kind, least = FALLBACK.get(site_key, ("divs", 0))
        if kind == "divs" and least:
            hit = [d for d in hit if len("".join(_texts(d))) > least]
    return hit[:n]


def parse_pages(pages: DataFrame, n: int | None = None) -> DataFrame:
    """(page_id, site_key, html) -> one row per container (the first ``n`` of a page, if given), and one
    row with ``error`` (and nothing else of the page) for each page that the parser fails on."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for pid, site, url, html in zip(b["page_id"], b["site_key"], b["url"], b["html"]):
                try:
                    rows += [(pid, site, url, i, _texts(c), _attr_values(c, "a", "href"), _attr_values(c, "img", "src"), None)
                             for i, c in enumerate(find_containers(html, site, n))]
                except Exception as e:  # noqa: BLE001  whatever one page raises is that page's error
                    rows.append((pid, site, url, None, None, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["page_id", "site_key", "url", "pos", "texts", "hrefs", "srcs", "error"])
            out["pos"] = out["pos"].astype("Int32")
            yield out

    return pages.select("page_id", "site_key", "url", "html").mapInPandas(split, CONTAINER_SCHEMA)


def containers(pages: DataFrame, n: int | None = None) -> DataFrame:
    """The containers of the pages that parse."""
    return parse_pages(pages, n).where("error IS NULL").drop("error")


def page_errors(pages: DataFrame, n: int | None = None) -> DataFrame:
    """``page_id, site_key, error`` of the pages that do not."""
    return parse_pages(pages, n).where("error IS NOT NULL").select("page_id", "site_key", "error")


def container_text(texts, word_limit: int | None = None) -> "F.Column":
    """Texts joined by ' | ', whitespace collapsed; with ``word_limit``, words as long are dropped."""
    t = F.regexp_replace(F.array_join(texts, " | "), F.lit(r"(?U)\s+"), F.lit(" "))
    words = F.filter(F.split(t, " "), lambda w: (F.length(w) > 0) if word_limit is None else (F.length(w) > 0) & (F.length(w) < word_limit))
    return F.array_join(words, " ")
