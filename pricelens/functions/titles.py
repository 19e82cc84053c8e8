"""Title and price rules of the retailer extractors as Column expressions
(E10-E11d, E13, E14). "First pattern whose cleaned result is valid" is a
``coalesce`` of ``when`` branches, so evaluation stops at the first hit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .prices import site_price_number, to_double
from .regex import collapse_ws, find_all, jre, let, matches_from_start, pystrip, search, sub, word_count


# ------------------------------------------------------------------ cleaning
def clean_extracted_title(col: Column, site_key: str) -> Column:
    """Clean a title found by a site pattern: prefixes, whitespace, trailing
    price, suffixes (the GHS sites share one rule set, AliExpress has its own)."""
    if site_key == "aliexpress":
        pre, trail, suf = (rules.ALIEXPRESS_TITLE_PREFIXES, rules.ALIEXPRESS_TITLE_TRAILERS,
                           rules.ALIEXPRESS_TITLE_SUFFIXES)
    else:
        pre, trail, suf = rules.GHS_TITLE_PREFIXES, rules.GHS_TITLE_TRAILERS, rules.GHS_TITLE_SUFFIXES
    t = col
    for p in pre:
        t = sub(t, p, flags="i")
    t = collapse_ws(t)
    for p in trail:
        t = sub(t, p)
    for p in suf:
        t = sub(t, p, flags="i")
    return pystrip(t)


def final_title(col: Column, site_key: str) -> Column:
    """The last clean-up before an offer is emitted (per site)."""
    t = col
    if site_key in rules.FINAL_TITLE_PREFIX:
        t = F.regexp_replace(t, F.lit(jre(rules.FINAL_TITLE_PREFIX[site_key], "i")), F.lit(""))
    t = collapse_ws(t)
    for p in rules.FINAL_TITLE_TRAILERS[site_key]:
        t = sub(t, p)
    return t


def generic_title(col: Column) -> Column:
    """Generic clean-up: cut at a price or the word 'price', collapse."""
    t = sub(col, rules.GENERIC_TITLE_PRICE_CUT)
    t = F.regexp_replace(t, F.lit(jre(rules.GENERIC_TITLE_WORD_CUT, "i")), F.lit(""))
    return collapse_ws(t)


def ebay_title(col: Column) -> Column:
    """eBay clean-up: model phrase, else from 'iPhone' on; drop after a dash."""
    model = search(col, rules.EBAY_CLEAN_MODEL, 1, flags="i")
    iphone = F.when(col.contains("iPhone"), search(col, rules.EBAY_CLEAN_IPHONE, 0, flags="i"))
    t = F.coalesce(pystrip(model), pystrip(iphone), col)
    t = F.regexp_replace(t, F.lit(r"(?Ud)\s+"), F.lit(" "))
    t = F.regexp_replace(t, F.lit(rules.EBAY_CLEAN_DASH), F.lit(""))
    return pystrip(t)


# ------------------------------------------------------------------ validity
def valid_title(col: Column, site_key: str = "jiji") -> Column:
    """Length >= 5, at least two words, not only digits/dashes/dots, not a noise word."""
    noise = rules.ALIEXPRESS_TITLE_NOISE if site_key == "aliexpress" else rules.GHS_TITLE_NOISE
    ok = (F.length(col) >= 5) & (word_count(col) >= 2) & ~matches_from_start(col, r"^[\d\s\-\.]+$")
    for p in noise:
        ok = ok & ~matches_from_start(col, p, flags="i")
    return F.coalesce(ok, F.lit(False))


# ------------------------------------------------------------------ site rules
def _site_title_flags(site_key: str) -> str:
    return "i" if site_key == "jumia" else "im"


def _keep_valid(site_key: str):
    return lambda v: F.when(valid_title(v, site_key), v)


def site_title(text: Column, site_key: str) -> Column:
    """Pattern mode: each pattern's first match, cleaned, must be valid; else the next pattern."""
    branches = []
    for p in rules.SITE_TITLE_PATTERNS[site_key]:
        cand = pystrip(F.regexp_extract(text, jre(p, _site_title_flags(site_key)), 1))
        if site_key == "jumia":
            c = pystrip(F.regexp_replace(cand, F.lit(jre(rules.JUMIA_TITLE_PREFIX, "i")), F.lit("")))
            branches.append(let(c, lambda v: F.when(F.length(v) > 10, v)))
        else:
            branches.append(let(clean_extracted_title(cand, site_key), _keep_valid(site_key)))
    return F.coalesce(*branches)


def site_price_text(text: Column, site_key: str) -> Column:
    """Pattern mode: for each pattern in order, the first match whose number is in range."""
    lo, hi = {k: (a, b) for k, _m, _w, a, b in rules.SITE_LIMITS}[site_key]
    branches = []
    for p in rules.SITE_PRICE_PATTERNS[site_key]:
        ms = find_all(text, p, 1)
        inr = F.filter(ms, lambda m: to_double(F.replace(m, F.lit(","), F.lit(""))).between(lo, hi))
        branches.append(F.get(inr, 0))
    return F.coalesce(*branches)


def fallback_title(text: Column, site_key: str) -> Column:
    """Fallback mode: first pattern that matches; no cleaning or checks."""
    return F.coalesce(*[F.nullif(pystrip(F.regexp_extract(text, jre(p, "i"), 1)), F.lit(""))
                        for p in rules.FALLBACK_TITLE_PATTERNS[site_key]])


def fallback_price_text(text: Column, site_key: str) -> Column:
    """Fallback mode: first match of the first pattern that matches."""
    return F.coalesce(*[search(text, p, 1) for p in rules.FALLBACK_PRICE_PATTERNS[site_key]])


def ebay_title_raw(text: Column) -> Column:
    """eBay: the first pattern whose match is longer than 5 characters."""
    out = []
    for p in rules.EBAY_TITLE_PATTERNS:
        m = pystrip(F.regexp_extract(text, jre(p, "i"), 1))
        out.append(F.when(F.length(m) > 5, m))
    return F.coalesce(*out)


def ebay_price_text(text: Column) -> Column:
    return F.coalesce(*[search(text, p, 1, flags="i") for p in rules.EBAY_PRICE_PATTERNS])


def site_offer_parts(text: Column, site_key: str, mode: str = "pattern") -> Column:
    """struct(title, price, found, min_len) of one container text: the cleaned title
    and parsed price computed once; ``offer_gate`` decides acceptance."""
    if site_key == "ebay":
        raw = F.struct(ebay_title_raw(text).alias("t"), ebay_price_text(text).alias("p"))
    elif mode == "pattern":
        raw = F.struct(site_title(text, site_key).alias("t"), site_price_text(text, site_key).alias("p"))
    else:
        raw = F.struct(fallback_title(text, site_key).alias("t"), fallback_price_text(text, site_key).alias("p"))

    def finish(r: Column) -> Column:
        if site_key == "ebay":
            title, price, min_len = ebay_title(r["t"]), site_price_number(r["p"], "ebay"), 3
        else:
            title, price, min_len = final_title(r["t"], site_key), site_price_number(r["p"], site_key), 5
        return F.struct(title.alias("title"), price.alias("price"),
                        (r["t"].isNotNull() & r["p"].isNotNull()).alias("found"), F.lit(min_len).alias("min_len"))
    return let(raw, finish)


def offer_gate(parts: Column) -> Column:
    """Title and price found, price > 0, title longer than the site's minimum."""
    return parts["found"] & (parts["price"] > 0) & (F.length(parts["title"]) > parts["min_len"])


def site_offer(text: Column, site_key: str, mode: str = "pattern") -> Column:
    """struct(title, price) of one container text under a site's rules, or NULL when
    the offer gate fails (single-expression form; jobs use ``site_offer_parts`` +
    ``offer_gate`` after a one-row explode so the parts are computed once)."""
    p = site_offer_parts(text, site_key, mode)
    return F.when(offer_gate(p), F.struct(p["title"].alias("title"), p["price"].alias("price")))
