"""Page text jobs as Column expressions.

Multi-line folds (the chunkers) use the ``aggregate`` higher-order function: it
runs inside the JVM, one row at a time, and its state holds only chunk
*boundaries* (start line, end line), never copies of text, so it stays linear
in the number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .regex import find_all, jre, let, pystrip

_BLOCK_TAGS = "p|div|h[1-6]|li|ul|ol|article|section|main|br|tr|table|blockquote|pre|dd|dt|figcaption|td|th"


# ------------------------------------------------------------------ E1
def clean_html(html: Column, noscript: bool = False) -> Column:
    """Remove script and style elements (and optionally noscript), collapse whitespace, trim."""
    tags = ["script", "style"] + (["noscript"] if noscript else [])
    h = html
    for t in tags:
        h = F.regexp_replace(h, F.lit(f"(?Uis)<{t}[^>]*>.*?</{t}>"), F.lit(""))
    return pystrip(F.regexp_replace(h, F.lit(r"(?U)\s+"), F.lit(" ")))


# ------------------------------------------------------------------ E2
def unescape(text: Column) -> Column:
    """The common named/numeric entities (``&amp;`` last)."""
    t = text
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
                    ("&nbsp;", " "), ("&amp;", "&")]:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return t


# Elements dropped with their content by the main-text rule.
BOILERPLATE_TAGS = ["script", "style", "noscript", "nav", "header", "footer", "aside", "form"]


LINK_LINE_CHARS = 25  # a line this long stays, however much of it is links (a product title often is one)
_LINK_ON, _LINK_OFF = "\x01", "\x02"
_BLANKS = r"[ \t\r\f\x0B]+"


def main_text_lines(html: Column) -> Column:
    """Main-text extraction to an array of lines.

    Drops head, comments and boilerplate elements (with their content), one
    element type per pass (a literal-prefixed pattern per pass scans faster than
    one alternation); block-level tags become line breaks; remaining tags go;
    entities are unescaped; each line is whitespace-collapsed and trimmed;
    empty lines go.

    Lines of menus and breadcrumbs go by their link density: anchors are kept as two marks up to the
    lines (an anchor around several lines is closed and opened again at each line break; one that never
    ends is none), and a line is dropped if it has fewer than ``LINK_LINE_CHARS`` characters and more
    than half of what is not blank stands inside anchors.
    """
    h = F.regexp_replace(F.translate(html, _LINK_ON + _LINK_OFF, ""), F.lit(r"(?is)<head[^>]*>.*?</head>|<!--.*?-->"), F.lit(""))
    for t in BOILERPLATE_TAGS:
        h = F.regexp_replace(h, F.lit(f"(?is)<{t}\\b[^>]*>.*?</{t}>"), F.lit(""))
    h = F.regexp_replace(F.regexp_replace(h, F.lit(r"(?i)<a\b[^>]*>"), F.lit(_LINK_ON)), F.lit(r"(?i)</a\s*>"), F.lit(_LINK_OFF))
    h = F.regexp_replace(h, F.lit(f"(?i)</?(?:{_BLOCK_TAGS})\\b[^>]*>"), F.lit("\n"))
    h = unescape(F.regexp_replace(h, F.lit(r"<[^>]*>"), F.lit("")))

    def by_line(part: Column, i: Column) -> Column:
        end = F.instr(part, _LINK_OFF)
        inside = F.replace(F.substring(part, F.lit(1), end - 1), F.lit("\n"), F.lit(_LINK_OFF + "\n" + _LINK_ON))
        return F.when((i > 0) & (end > 0), F.concat(inside, F.substring(part, end, F.length(part)))).otherwise(part)

    def measured(ln: Column) -> Column:
        blank = lambda x: F.regexp_replace(x, F.lit(_BLANKS), F.lit(""))
        plain = F.translate(ln, _LINK_ON + _LINK_OFF, "")
        links = F.array_join(F.regexp_extract_all(ln, F.lit(f"{_LINK_ON}([^{_LINK_ON}{_LINK_OFF}]*){_LINK_OFF}"), F.lit(1)), "")
        return F.struct(pystrip(F.regexp_replace(plain, F.lit(_BLANKS), F.lit(" "))).alias("text"),
                        F.length(blank(plain)).alias("all"), F.length(blank(links)).alias("linked"))
    h = F.array_join(F.transform(F.split(h, _LINK_ON), by_line), _LINK_ON)
    lines = F.filter(F.transform(F.split(h, "\n"), measured), lambda x: (x["text"] != "") & (
        (F.length(x["text"]) >= LINK_LINE_CHARS) | (x["linked"] * 2 <= x["all"])))
    return F.transform(lines, lambda x: x["text"])


def page_text(html: Column, min_chars: int = 1) -> Column:
    """Main text (lines joined by newline); NULL when shorter than ``min_chars`` (by default, when empty)."""
    return let(F.array_join(main_text_lines(html), "\n"), lambda t: F.when(F.length(t) >= min_chars, t))


def if_present(value: Column) -> Column:
    """A generator column: one row holding ``value`` when it is not NULL, none otherwise.

    Use as ``select(..., F.explode(if_present(expr)).alias(name))`` instead of
    computing ``expr`` and then filtering on it: the optimizer would push the
    filter below the projection and evaluate ``expr`` twice.
    """
    return F.filter(F.array(value), lambda v: v.isNotNull())


# ------------------------------------------------------------------ E3
def window_pattern(max_chars: int) -> str:
    """One regex whose successive matches are the fixed windows: the whole text
    if it fits; else a tail that fits; else the longest piece ending right before a
    space (the next window starts at that space); else ``max_chars`` characters."""
    L = max_chars
    return rf"(?s)^.{{0,{L}}}\z|.{{1,{L}}}\z|.{{1,{L - 1}}}(?= )|.{{1,{L}}}"


def window_chunks(text: Column, max_tokens: int = rules.WINDOW_TOKENS) -> Column:
    """Fixed-size windows of at most ``max_tokens * 3`` characters, broken at spaces."""
    return F.regexp_extract_all(text, F.lit(window_pattern(max_tokens * rules.WINDOW_CHARS_PER_TOKEN)), F.lit(0))


# ------------------------------------------------------------------ E8, E8b, E8c
def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved (query and fragment untouched)."""
    p = F.regexp_extract(path, r"^([^?#]*)", 1)
    rest = F.regexp_extract(path, r"^[^?#]*([\s\S]*)$", 1)
    segs = F.split(p, "/")

    def step(acc, x):
        up = F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return F.when(x == ".", acc).when(x == "..", up).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(segs, F.array().cast("array<string>"), step)
    # a last segment that went leaves its slash
    tail = F.when(F.element_at(segs, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.when(p.contains("/."), F.concat(F.array_join(kept, "/"), tail, rest)).otherwise(path)


def url_join(base: Column, ref: Column) -> Column:
    """Resolve a reference against a page URL (absolute, //host, /path, ?q, #f, relative with
    ``.`` and ``..`` segments)."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    no_frag = F.regexp_extract(base, r"^([^#]*)", 1)
    no_query = F.regexp_extract(base, r"^([^?#]*)", 1)
    path = F.regexp_extract(no_query, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    dir_ = F.regexp_extract(path, r"^(.*/)", 1)
    return (F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
            .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
            .when(ref.startswith("/"), F.concat(origin, without_dots(ref)))
            .when(ref.startswith("?"), F.concat(no_query, ref))
            .when(ref.startswith("#"), F.concat(no_frag, ref))
            .when(ref == "", base)
            .otherwise(F.concat(origin, without_dots(F.concat(F.when(dir_ == "", F.lit("/")).otherwise(dir_), ref)))))


def _first(items: Column, n: int | None) -> Column:
    return items if n is None else F.slice(items, 1, n)


def page_links(html: Column, base: Column, cap: int | None = None) -> Column:
    """Product-like links: three href patterns in order, resolved, first occurrence kept (the
    first ``cap``, if given)."""
    found = F.concat(*[find_all(html, p, 1, flags="i") for p in rules.PAGE_LINK_PATTERNS])
    return _first(F.array_distinct(F.transform(found, lambda u: url_join(base, u))), cap)


def page_images(html: Column, cap: int | None = None) -> Column:
    """Images (src then data-src) whose URL mentions product/item; duplicates kept (the first
    ``cap``, if given)."""
    found = F.concat(*[find_all(html, p, 1, flags="i") for p in rules.PAGE_IMAGE_PATTERNS])
    keep = F.filter(found, lambda u: F.lower(u).contains("product") | F.lower(u).contains("item"))
    return _first(keep, cap)


def page_pools(html: Column, n: int | None = None) -> Column:
    """eBay pools: item URLs and CDN images, else any https URL / any image; each pool is the
    list twice. With ``n``, fallback lists are cut to n and pools to 2n."""
    def pool(primary: Column, fallback_pattern: str) -> Column:
        return let(primary, lambda a: let(
            F.when(F.size(a) > 0, a).otherwise(
                _first(F.regexp_extract_all(html, F.lit(fallback_pattern), F.lit(0)), n)),
            lambda b: _first(F.concat(b, b), n and 2 * n)))
    urls = pool(F.regexp_extract_all(html, F.lit(rules.EBAY_ITEM_URL), F.lit(0)), rules.ANY_HTTPS_URL)
    imgs = pool(F.regexp_extract_all(html, F.lit(rules.EBAY_IMAGE_URL), F.lit(0)), rules.ANY_IMAGE_URL)
    return F.struct(urls.alias("urls"), imgs.alias("images"))


def _chunk_bounds(lens: Column, flags: Column, max_len: int | None, min_keep: int | None,
                  cap: int | None = None, close_over: int | None = None) -> Column:
    """Chunk boundaries from per-line lengths and per-line "closing" flags.

    A chunk of >= 2 lines closes at a flagged line (or, with ``close_over``, once
    it is longer than that); a closed chunk shorter than ``min_keep`` is dropped
    (its lines are consumed anyway); with ``max_len`` a chunk longer than that
    ends regardless; the tail is kept; the first ``cap`` chunks, if given. The fold state is
    four integers and the boundary list -- no text is copied.
    """
    init = F.struct(F.lit(0).alias("i"), F.lit(0).alias("s"), F.lit(0).alias("n"), F.lit(0).alias("len"),
                    F.array().cast("array<struct<s:int,e:int>>").alias("b"))

    def room(acc):
        return F.lit(True) if cap is None else F.size(acc["b"]) < cap

    def step(acc, x):
        i = acc["i"]
        n2 = acc["n"] + 1
        len2 = F.when(acc["n"] == 0, x["l"]).otherwise(acc["len"] + 1 + x["l"])
        trig = x["f"] | (len2 > close_over) if close_over is not None else x["f"]
        close = (n2 >= 2) & trig
        emit_close = close if min_keep is None else (close & (len2 > min_keep))
        over = (~close & (len2 > max_len)) if max_len is not None else F.lit(False)
        emit = (emit_close | over) & room(acc)
        b2 = F.when(emit, F.concat(acc["b"], F.array(F.struct(acc["s"].alias("s"), (i + 1).alias("e")))))\
            .otherwise(acc["b"])
        reset = close | over
        return F.struct((i + 1).alias("i"),
                        F.when(reset, i + 1).otherwise(acc["s"]).alias("s"),
                        F.when(reset, F.lit(0)).otherwise(n2).alias("n"),
                        F.when(reset, F.lit(0)).otherwise(len2).alias("len"),
                        b2.alias("b"))

    def finish(acc):
        return F.when((acc["n"] > 0) & room(acc),
                      F.concat(acc["b"], F.array(F.struct(acc["s"].alias("s"), (acc["s"] + acc["n"]).alias("e")))))\
            .otherwise(acc["b"])

    items = F.transform(F.arrays_zip(lens.alias("l"), flags.alias("f")),
                        lambda z: F.struct(z["l"].alias("l"), z["f"].alias("f")))
    return F.aggregate(items, init, step, finish)


def chunk_lines(text: Column) -> Column:
    """Trimmed, non-empty lines of a text."""
    return F.array_remove(F.transform(F.split(text, "\n"), lambda ln: pystrip(ln)), "")


def generic_flags(lines: Column) -> Column:
    """Per line: price-like (``[$₵€£] n`` or ``price ... n``) or holding an indicator word (lower-cased)."""
    ind = F.lit(list(rules.GENERIC_CHUNK_INDICATORS))
    return F.transform(F.transform(lines, lambda l: F.lower(l)),
                       lambda low: low.rlike(jre(rules.GENERIC_CHUNK_PRICE)) | F.exists(ind, lambda w: low.contains(w)))


def ebay_flags(lines: Column) -> Column:
    """Per line: holds ``$ n`` or ``USD n``."""
    return F.transform(lines, lambda l: l.rlike(jre(rules.EBAY_CHUNK_PRICE)))


def chunk_array(text: Column, rule: str = "generic", cap: int | None = None, min_keep: int | None = None) -> Column:
    """The chunk array of ``text`` (E9 generic rule, or E9b with ``rule='ebay'``). With ``cap``,
    the first chunks only; with ``min_keep``, generic chunks of at most so many characters go.

    The line array is bound once (``let``); per-line lengths and closing flags
    are computed from it by ``transform``; the fold only combines integers and
    booleans; chunks are slices of the bound line array.
    """
    def build(ls: Column) -> Column:
        lens = F.transform(ls, lambda l: F.length(l))
        if rule == "ebay":
            bounds = _chunk_bounds(lens, ebay_flags(ls), None, None, cap, close_over=rules.EBAY_CHUNK_MAX)
        else:
            bounds = _chunk_bounds(lens, generic_flags(ls), rules.GENERIC_CHUNK_MAX, min_keep, cap)
        return F.transform(bounds, lambda c: F.array_join(F.slice(ls, c["s"] + 1, c["e"] - c["s"]), "\n"))
    return let(chunk_lines(text), build)


def with_chunks(df, text: str = "text", out: str = "chunks", rule: str = "generic"):
    """Add the chunk array of column ``text``."""
    return df.withColumn(out, chunk_array(F.col(text), rule))
