"""The extraction rules spelled as DuckDB SQL expressions (oracle side).

These build SQL text from the same fixed values in ``functions.rules``. RE2 has
no look-ahead; a trailing ``(?=X)`` is written as ``(?:X)``, which yields the
same first match and group for the single-match extraction used here.
"""

from __future__ import annotations

from ..functions import rules
from ..functions.regex import sql_re, sql_str


def let(value: str, var: str, body: str) -> str:
    """Bind ``value`` once as ``var`` inside ``body`` (a one-element list_transform)."""
    return f"list_transform([{value}], lambda {var}: {body})[1]"


def re_(p: str, flags: str = "") -> str:
    return sql_re(p.replace("(?=", "(?:"), flags)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def sub(x: str, p: str, flags: str = "") -> str:
    return f"regexp_replace({x}, {re_(p, flags)}, '', 'g')"


def search(x: str, p: str, g: int = 1, flags: str = "") -> str:
    return f"nullif(regexp_extract({x}, {re_(p, flags)}, {g}), '')"


def words(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '\\s+'), lambda w: length(w) > 0))"


def numeric_price(x: str) -> str:
    first = f"nullif(regexp_extract(regexp_replace({x}, '[₵$£€,]', '', 'g'), '[0-9.]+', 0), '')"
    return f"coalesce(TRY_CAST({first} AS DOUBLE), 0.0)"


def currency_of(x: str) -> str:
    whens = " ".join(f"WHEN contains({x}, {sql_str(s)}) THEN '{c}'" for s, c in rules.CURRENCY_SYMBOLS)
    return f"(CASE {whens} ELSE '' END)"


def amount_of(x: str) -> str:
    return f"coalesce(TRY_CAST(replace({search(x, rules.AMOUNT_PATTERN)}, ',', '') AS DOUBLE), 0.0)"


def site_price_number(x: str, site: str) -> str:
    if site == "aliexpress":
        c = f"replace(regexp_replace({x}, '[$,\\s]', '', 'g'), 'USD', '')"
    elif site == "ebay":
        c = f"replace(regexp_replace({x}, '[^0-9.,]', '', 'g'), ',', '')"
    else:
        c = f"replace(regexp_replace({x}, '[₵,\\s]', '', 'g'), 'GH', '')"
    return f"coalesce(TRY_CAST(nullif({c}, '') AS DOUBLE), 0.0)"


def clean_extracted_title(x: str, site: str) -> str:
    if site == "aliexpress":
        pre, trail, suf = (rules.ALIEXPRESS_TITLE_PREFIXES, rules.ALIEXPRESS_TITLE_TRAILERS,
                           rules.ALIEXPRESS_TITLE_SUFFIXES)
    else:
        pre, trail, suf = rules.GHS_TITLE_PREFIXES, rules.GHS_TITLE_TRAILERS, rules.GHS_TITLE_SUFFIXES
    t = x
    for p in pre:
        t = sub(t, p, "i")
    t = collapse(t)
    for p in trail:
        t = sub(t, p)
    for p in suf:
        t = sub(t, p, "i")
    return strip(t)


def final_title(x: str, site: str) -> str:
    t = x
    if site in rules.FINAL_TITLE_PREFIX:
        t = sub(t, rules.FINAL_TITLE_PREFIX[site], "i")
    t = collapse(t)
    for p in rules.FINAL_TITLE_TRAILERS[site]:
        t = sub(t, p)
    return t


def generic_title(x: str) -> str:
    t = sub(x, rules.GENERIC_TITLE_PRICE_CUT)
    t = sub(t, rules.GENERIC_TITLE_WORD_CUT, "i")
    return collapse(t)


def ebay_title(x: str) -> str:
    model = strip(search(x, rules.EBAY_CLEAN_MODEL, 1, "i"))
    iphone = f"CASE WHEN contains({x}, 'iPhone') THEN {strip(search(x, rules.EBAY_CLEAN_IPHONE, 0, 'i'))} END"
    t = f"coalesce({model}, {iphone}, {x})"
    t = f"regexp_replace({t}, '\\s+', ' ', 'g')"
    t = f"regexp_replace({t}, {sql_str(rules.EBAY_CLEAN_DASH)}, '', 'g')"
    return strip(t)


def valid_title(x: str, site: str = "jiji") -> str:
    noise = rules.ALIEXPRESS_TITLE_NOISE if site == "aliexpress" else rules.GHS_TITLE_NOISE
    conds = [f"length({x}) >= 5", f"{words(x)} >= 2", f"NOT regexp_matches({x}, '^[0-9\\s\\-\\.]+$')"]
    conds += [f"NOT regexp_matches({x}, {re_(p, 'i')})" for p in noise]
    return "coalesce((" + " AND ".join(conds) + "), FALSE)"


def site_title(x: str, site: str) -> str:
    flags = "i" if site == "jumia" else "im"
    branches = []
    for p in rules.SITE_TITLE_PATTERNS[site]:
        cand = strip(f"regexp_extract({x}, {re_(p, flags)}, 1)")
        if site == "jumia":
            c = strip(sub(cand, rules.JUMIA_TITLE_PREFIX, "i"))
            branches.append(let(c, "_c", "CASE WHEN length(_c) > 10 THEN _c END"))
        else:
            c = clean_extracted_title(cand, site)
            branches.append(let(c, "_c", f"CASE WHEN {valid_title('_c', site)} THEN _c END"))
    return "coalesce(" + ", ".join(branches) + ")"


def site_price_text(x: str, site: str) -> str:
    lo, hi = {k: (a, b) for k, _m, _w, a, b in rules.SITE_LIMITS}[site]
    out = []
    for p in rules.SITE_PRICE_PATTERNS[site]:
        out.append(f"list_filter(regexp_extract_all({x}, {re_(p)}, 1), "
                   f"lambda m: TRY_CAST(replace(m, ',', '') AS DOUBLE) BETWEEN {lo} AND {hi})[1]")
    return "coalesce(" + ", ".join(out) + ")"


def fallback_title(x: str, site: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({strip(f'regexp_extract({x}, {re_(p, chr(105))}, 1)')}, '')"
                                   for p in rules.FALLBACK_TITLE_PATTERNS[site]) + ")"


def fallback_price_text(x: str, site: str) -> str:
    return "coalesce(" + ", ".join(search(x, p) for p in rules.FALLBACK_PRICE_PATTERNS[site]) + ")"


def ebay_title_raw(x: str) -> str:
    out = []
    for p in rules.EBAY_TITLE_PATTERNS:
        m = strip(f"regexp_extract({x}, {re_(p, 'i')}, 1)")
        out.append(f"CASE WHEN length({m}) > 5 THEN {m} END")
    return "coalesce(" + ", ".join(out) + ")"


def ebay_price_text(x: str) -> str:
    return "coalesce(" + ", ".join(search(x, p, 1, "i") for p in rules.EBAY_PRICE_PATTERNS) + ")"


def site_offer(x: str, site: str, mode: str = "pattern") -> tuple[str, str, str]:
    """(ok, title, price) SQL expressions."""
    if site == "ebay":
        rt, rp = ebay_title_raw(x), ebay_price_text(x)
        t, pr = ebay_title(rt), site_price_number(rp, "ebay")
        gate = f"length({t}) > 3"
    else:
        if mode == "pattern":
            rt, rp = site_title(x, site), site_price_text(x, site)
        else:
            rt, rp = fallback_title(x, site), fallback_price_text(x, site)
        t, pr = final_title(rt, site), site_price_number(rp, site)
        gate = f"length({t}) > 5"
    # bind the raw title and price once; the three results read the bound values
    raw = f"struct_pack(t := {rt}, p := {rp})"
    t_b = t.replace(rt, "_r.t") if rt in t else t
    pr_b = pr.replace(rp, "_r.p") if rp in pr else pr
    gate_b = gate.replace(t, t_b)
    ok = let(raw, "_r", f"coalesce(_r.t IS NOT NULL AND _r.p IS NOT NULL AND {pr_b} > 0 AND {gate_b}, FALSE)")
    return ok, let(raw, "_r", t_b), let(raw, "_r", pr_b)


# ------------------------------------------------------------------ entities
def title_entities(x: str) -> str:
    parts = [f"list_transform(regexp_extract_all({x}, {re_(p, 'im')}, 1), lambda w: {strip('w')})"
             for p in rules.ENTITY_TITLE_PATTERNS]
    return "list_concat(" + ", ".join(parts) + ")"


def price_entities(x: str) -> str:
    parts = [f"list_transform(regexp_extract_all({x}, {re_(p, 'i')}, 1), lambda w: {strip('w')})"
             for p in rules.ENTITY_PRICE_PATTERNS]
    return "list_concat(" + ", ".join(parts) + ")"


def longest(lst: str) -> str:
    return (f"CASE WHEN len({lst}) > 0 THEN list_reduce({lst}, lambda acc, v: "
            f"CASE WHEN length(v) > length(acc) THEN v ELSE acc END) END")


def title_fallback(x: str) -> str:
    lines = f"list_transform(string_split({x}, chr(10)), lambda ln: {strip('ln')})"
    ok = (f"list_filter({lines}, lambda ln: length(ln) > 10 AND length(ln) < 100 AND "
          f"NOT regexp_matches(ln, {re_(rules.TITLE_FALLBACK_REJECT, 'i')}))")
    return f"coalesce({generic_title(ok + '[1]')}, '')"


def price_fallback(x: str) -> tuple[str, str]:
    m = "coalesce(" + ", ".join(search(x, p) for p in rules.PRICE_FALLBACK_PATTERNS) + ")"
    return (f"CASE WHEN {m} IS NOT NULL THEN {amount_of(m)} ELSE 0.0 END",
            f"CASE WHEN {m} IS NOT NULL THEN {currency_of(m)} ELSE '' END")


def entity_offer(x: str) -> dict[str, str]:
    t = longest(title_entities(x))
    fp = f"{price_entities(x)}[1]"
    title = f"coalesce(nullif({generic_title(t)}, ''), {title_fallback(x)})"
    has = f"(({fp}) IS NOT NULL AND {amount_of(fp)} <> 0)"
    fa, fc = price_fallback(x)
    return {"title": title,
            "price": f"CASE WHEN {has} THEN {amount_of(fp)} ELSE {fa} END",
            "currency": f"CASE WHEN {has} THEN {currency_of(fp)} ELSE {fc} END",
            "description": x}
