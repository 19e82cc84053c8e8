"""Scalar extraction rules over listing texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import entities as EN
from ..functions import prices as PR
from ..functions import rules
from ..functions import titles as TI
from ..functions import text as TX
from ..operators import extract as X
from ..operators.windows import skew_safe_row_number
from ..sources import fixtures as fx
from . import sql_rules as S
from .registry import query

CONTAINER_SITES = ["jiji", "jumia", "tonaton", "aliexpress"]
_SITES_SQL = "(VALUES " + ", ".join(f"('{k}')" for k in CONTAINER_SITES) + ") AS st(site_key)"


def _per_site(df, fn) -> Column:
    """CASE over the site key: only the matching site's rules are evaluated."""
    out = None
    for k in CONTAINER_SITES:
        out = (F.when(F.col("site_key") == k, fn(k)) if out is None
               else out.when(F.col("site_key") == k, fn(k)))
    return out


def _per_site_sql(fn) -> str:
    return "CASE site_key " + " ".join(f"WHEN '{k}' THEN {fn(k)}" for k in CONTAINER_SITES) + " END"


def _by_site(spark, sf_dir):
    return fx.listing_text(spark, sf_dir).select(
        "id", "text", F.explode(F.array(*[F.lit(k) for k in CONTAINER_SITES])).alias("site_key"))


@query("parse_prices", sql=f"""SELECT id, {S.amount_of('text')} AS amount, {S.currency_of('text')} AS currency
  FROM listing_text""", fixtures=["listing_text"])
def parse_prices(spark, sf_dir):
    """Price text -> (amount, currency)."""
    lt = fx.listing_text(spark, sf_dir)
    return lt.select("id", PR.amount_of(F.col("text")).alias("amount"), PR.currency_of(F.col("text")).alias("currency"))


@query("numeric_prices", sql=f"SELECT id, {S.numeric_price('text')} AS price_num FROM listing_text",
       fixtures=["listing_text"])
def numeric_prices(spark, sf_dir):
    """Text -> number (currency symbols and commas dropped, first number, else 0)."""
    return fx.listing_text(spark, sf_dir).select("id", PR.numeric_price(F.col("text")).alias("price_num"))


@query("format_prices", sql=f"""SELECT id,
  CASE WHEN {S.numeric_price('text')} > 0 THEN '₵ ' || format('{{:,.2f}}', {S.numeric_price('text')}) ELSE text END
    AS text_display,
  CASE WHEN {S.currency_of('text')} = 'GHS' THEN '₵ ' ELSE '$' END || format('{{:,.2f}}', {S.amount_of('text')})
    AS number_display
  FROM listing_text""", fixtures=["listing_text"])
def format_prices(spark, sf_dir):
    """Display strings for text prices and for numbers with their currency."""
    t = F.col("text")
    return fx.listing_text(spark, sf_dir).select(
        "id", PR.format_price_text(t).alias("text_display"),
        PR.format_price_number(PR.amount_of(t), PR.currency_of(t)).alias("number_display"))


@query("convert_currency", sql=f"""SELECT id, amount, currency, amount * coalesce(rate, 1.0::DOUBLE) AS amount_ghs FROM (
  SELECT id, {S.amount_of('text')} AS amount, {S.currency_of('text')} AS currency FROM listing_text) t
  LEFT JOIN rates USING (currency)""", fixtures=["listing_text", "rates"])
def convert_currency(spark, sf_dir):
    """P5: amounts converted to GHS at the rate of their currency; those without a rate unchanged."""
    t = F.col("text")
    df = fx.listing_text(spark, sf_dir).select("id", PR.amount_of(t).alias("amount"), PR.currency_of(t).alias("currency"))
    return X.convert_currency(df, fx.rates(spark)).select("id", "amount", "currency", "amount_ghs")


@query("site_titles", sql=f"""SELECT id, site_key, {_per_site_sql(lambda k: S.site_title('text', k))} AS title
  FROM listing_text, {_SITES_SQL}""", fixtures=["listing_text"])
def site_titles(spark, sf_dir):
    """Per-site title patterns, first valid cleaned candidate."""
    df = _by_site(spark, sf_dir)
    return df.select("id", "site_key", _per_site(df, lambda k: TI.site_title(F.col("text"), k)).alias("title"))


@query("site_prices", sql=f"""SELECT id, site_key, price_text,
  {_per_site_sql(lambda k: S.site_price_number('price_text', k))} AS price
  FROM (SELECT id, site_key, {_per_site_sql(lambda k: S.site_price_text('text', k))} AS price_text
        FROM listing_text, {_SITES_SQL}) x""", fixtures=["listing_text"])
def site_prices(spark, sf_dir):
    """Per-site price patterns with range check, then text -> number."""
    df = _by_site(spark, sf_dir)
    pt = _per_site(df, lambda k: TI.site_price_text(F.col("text"), k))
    df = df.select("id", "site_key", pt.alias("price_text"))
    return df.select("id", "site_key", "price_text",
                     _per_site(df, lambda k: PR.site_price_number(F.col("price_text"), k)).alias("price"))


def _offer_sql(mode: str) -> str:
    parts = {k: S.site_offer("text", k, mode) for k in CONTAINER_SITES}
    ok = "CASE site_key " + " ".join(f"WHEN '{k}' THEN {parts[k][0]}" for k in CONTAINER_SITES) + " END"
    t = "CASE site_key " + " ".join(f"WHEN '{k}' THEN {parts[k][1]}" for k in CONTAINER_SITES) + " END"
    p = "CASE site_key " + " ".join(f"WHEN '{k}' THEN {parts[k][2]}" for k in CONTAINER_SITES) + " END"
    return f"""SELECT id, site_key, title, price FROM (SELECT id, site_key, {ok} AS ok, {t} AS title, {p} AS price
  FROM listing_text, {_SITES_SQL}) x WHERE ok"""


def _offers(spark, sf_dir, mode):
    df = _by_site(spark, sf_dir)
    o = _per_site(df, lambda k: TI.site_offer_parts(F.col("text"), k, mode))
    # the parts are computed once inside the generator; the gate filters its output
    return (df.select("id", "site_key", F.explode(F.array(o)).alias("o")).filter(TI.offer_gate(F.col("o")))
            .select("id", "site_key", "o.title", "o.price"))


@query("site_offers", sql=_offer_sql("pattern"), fixtures=["listing_text"])
def site_offers(spark, sf_dir):
    """E11+E11b+E13+gate: per-site offers from container texts, pattern mode."""
    return _offers(spark, sf_dir, "pattern")


@query("site_fallback", sql=_offer_sql("fallback"), fixtures=["listing_text"])
def site_fallback(spark, sf_dir):
    """Per-site offers in fallback mode (fewer patterns, no checks)."""
    return _offers(spark, sf_dir, "fallback")


_EB = S.site_offer("text", "ebay")


@query("ebay_offers", sql=f"""SELECT id, title, price FROM (SELECT id, {_EB[0]} AS ok, {_EB[1]} AS title,
  {_EB[2]} AS price FROM listing_text) x WHERE ok""", fixtures=["listing_text"])
def ebay_offers(spark, sf_dir):
    """E11d: eBay title/price rules with its own clean-up and gate."""
    o = TI.site_offer_parts(F.col("text"), "ebay")
    return (fx.listing_text(spark, sf_dir).select("id", F.explode(F.array(o)).alias("o"))
            .filter(TI.offer_gate(F.col("o"))).select("id", "o.title", "o.price"))


@query("clean_titles", sql=f"""SELECT id, {S.generic_title('text')} AS generic,
  {S.clean_extracted_title('text', 'jiji')} AS extracted_ghs,
  {S.clean_extracted_title('text', 'aliexpress')} AS extracted_usd,
  {S.final_title('text', 'jiji')} AS final_jiji, {S.ebay_title('text')} AS ebay FROM listing_text""",
       fixtures=["listing_text"])
def clean_titles(spark, sf_dir):
    """The title clean-up rules applied to listing texts."""
    t = F.col("text")
    return fx.listing_text(spark, sf_dir).select(
        "id", TI.generic_title(t).alias("generic"), TI.clean_extracted_title(t, "jiji").alias("extracted_ghs"),
        TI.clean_extracted_title(t, "aliexpress").alias("extracted_usd"), TI.final_title(t, "jiji").alias("final_jiji"),
        TI.ebay_title(t).alias("ebay"))


@query("valid_titles", sql=f"""SELECT id, {S.valid_title(S.clean_extracted_title('text', 'jiji'), 'jiji')} AS valid_ghs,
  {S.valid_title(S.clean_extracted_title('text', 'aliexpress'), 'aliexpress')} AS valid_usd,
  {S.valid_title('regexp_extract(text, ' + chr(39) + '^\\S+' + chr(39) + ', 0)')} AS valid_first_word
  FROM listing_text""", fixtures=["listing_text"])
def valid_titles(spark, sf_dir):
    """Title validity (length, two words, not numeric, not a noise word)."""
    t = F.col("text")
    return fx.listing_text(spark, sf_dir).select(
        "id", TI.valid_title(TI.clean_extracted_title(t, "jiji"), "jiji").alias("valid_ghs"),
        TI.valid_title(TI.clean_extracted_title(t, "aliexpress"), "aliexpress").alias("valid_usd"),
        TI.valid_title(F.regexp_extract(t, r"^\S+", 0)).alias("valid_first_word"))


def _entity_sql(group: str, score: float, pattern: str, flags: str) -> str:
    """Matches of a pattern with their spans: the text is cut at marks set around each match."""
    parts = f"string_split(regexp_replace(text, {S.re_(pattern, flags)}, chr(1) || '\\0' || chr(2), 'g'), chr(1))"
    before = "CAST(coalesce(list_sum(list_transform(ps[1:k], lambda p: length(replace(p, chr(2), '')))), 0) AS INTEGER)"
    return (f"(SELECT coalesce(list(struct_pack(entity_group := '{group}', word := {S.strip('ws[k]')}, score := {score}::DOUBLE, start := {before}, "
            f"\"end\" := {before} + CAST(strpos(ps[k + 1], chr(2)) - 1 AS INTEGER)) ORDER BY k), []) FROM (SELECT unnest(range(1, len(ws) + 1)) AS k, ws, ps FROM ("
            f"SELECT regexp_extract_all(text, {S.re_(pattern, flags)}, 1) AS ws, {parts} AS ps)))")


_ENT_LIST = "list_concat(" + ", ".join([*(_entity_sql("TITLE", rules.ENTITY_TITLE_SCORE, p, "im") for p in rules.ENTITY_TITLE_PATTERNS),
                                        *(_entity_sql("PRICE", rules.ENTITY_PRICE_SCORE, p, "i") for p in rules.ENTITY_PRICE_PATTERNS)]) + ")"


@query("entities", sql=f"""SELECT id, e.entity_group, CAST(i - 1 AS INTEGER) AS ordinal, e.word, e.score, e.start, e.end FROM (
  SELECT id, unnest(L) AS e, generate_subscripts(L, 1) AS i FROM (SELECT id, {_ENT_LIST} AS L FROM listing_text) a) b""",
       fixtures=["listing_text"])
def entities(spark, sf_dir):
    """Rule-based TITLE / PRICE entities with their offsets, one row per entity."""
    lt = fx.listing_text(spark, sf_dir)
    return lt.select("id", F.explode(EN.entities(F.col("text"))).alias("e")).select(
        "id", "e.entity_group", F.col("e.ordinal").alias("ordinal"), "e.word", "e.score", "e.start", "e.end")


_EO = S.entity_offer("text")


@query("entity_offers", sql=f"""SELECT id, {_EO['title']} AS title, {_EO['price']} AS price,
  {_EO['currency']} AS currency, {_EO['description']} AS description FROM listing_text""", fixtures=["listing_text"])
def entity_offers(spark, sf_dir):
    """Entities -> offer fields, with title and price fallbacks."""
    return fx.listing_text(spark, sf_dir).select("id", EN.entity_offer(F.col("text")).alias("o")).select(
        "id", "o.title", "o.price", "o.currency", "o.description")


@query("title_fallback", sql=f"SELECT id, {S.title_fallback('text')} AS title FROM listing_text",
       fixtures=["listing_text"])
def title_fallback(spark, sf_dir):
    """First plausible line as the title."""
    return fx.listing_text(spark, sf_dir).select("id", EN.title_fallback(F.col("text")).alias("title"))


_PF = S.price_fallback("text")


@query("price_fallback", sql=f"SELECT id, {_PF[0]} AS amount, {_PF[1]} AS currency FROM listing_text",
       fixtures=["listing_text"])
def price_fallback(spark, sf_dir):
    """Price from the two fallback patterns."""
    pf = EN.price_fallback(F.col("text"))
    return fx.listing_text(spark, sf_dir).select("id", pf["amount"].alias("amount"), pf["currency"].alias("currency"))


@query("offer_id", sql=f"""SELECT query_id, site_key, pos,
  site_key || '_' || substr(sha256(title || CAST(pos AS VARCHAR)), 1, 16) AS id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, site_ord ORDER BY {fx.LINE_ORDER_SQL}) - 1 AS pos FROM offers) u""",
       fixtures=["offers", "searches"])
def offer_id(spark, sf_dir):
    """Stable offer id from site key, title and position in the site's list, for all offers."""
    o = fx.offers(spark, sf_dir).withColumn("_list", F.concat_ws("|", "query_id", "site_ord"))
    o = skew_safe_row_number(o, "_list", fx.LINE_ORDER, "_no").withColumn("pos", F.col("_no") - 1)
    return X.with_offer_id(o).select("query_id", "site_key", "pos", "id")


_HOST_SQL = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


@query("identify_source", sql=f"""SELECT page_id, CASE {' '.join(f"WHEN contains({_HOST_SQL}, '{h}') THEN '{n}'" for h, n, _k in rules.HOST_SOURCES)} ELSE 'Unknown' END AS source,
  CASE {' '.join(f"WHEN contains({_HOST_SQL}, '{h}') THEN '{k}'" for h, _n, k in rules.HOST_SOURCES)} ELSE 'unknown' END AS source_key
  FROM (SELECT page_id, url FROM pages UNION ALL SELECT page_id, url FROM listing_pages) p""",
       fixtures=["listing_pages"])
def identify_source(spark, sf_dir):
    """Source from the URL host (first matching host marker), for raw and listing pages."""
    from ..sources.tables import load
    pages = load(spark, sf_dir, "pages").select("page_id", "url").unionByName(
        fx.listing_pages(spark, sf_dir).select("page_id", "url"))
    s = X.identify_source(F.col("url"))
    return pages.select("page_id", s["source"].alias("source"), s["source_key"].alias("source_key"))
