"""Page -> offer jobs and their row-level helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.regex import let
from ..session import scratch_path


def convert_currency(df: DataFrame, rates: DataFrame, amount: str = "amount", currency: str = "currency", out: str = "amount_ghs") -> DataFrame:
    """``amount * rate`` for currencies that ``rates(currency, rate)`` has (one row each), else the amount unchanged."""
    r = rates.select(F.col("currency").alias("_currency"), F.col("rate").cast("double").alias("_rate"))
    return df.join(r, F.col(currency) == F.col("_currency"), "left").withColumn(out, F.col(amount) * F.coalesce("_rate", F.lit(1.0))).drop("_currency", "_rate")


def offer_id(site_key: Column, title: Column, pos: Column) -> Column:
    """Stable id: site key + 16 hex digits of sha-256(title + position)."""
    return F.concat(site_key, F.lit("_"), F.substring(F.sha2(F.concat(title, pos.cast("string")), 256), 1, 16))


def with_offer_id(df: DataFrame) -> DataFrame:
    return df.withColumn("id", offer_id(F.col("site_key"), F.col("title"), F.col("pos")))


def url_host(url: Column) -> Column:
    """Lower-cased authority of ``scheme://authority/...`` (port and user info kept)."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def identify_source(url: Column) -> Column:
    """struct(source, source_key) from the host: first matching marker, else Unknown."""
    host = url_host(url)
    src, key = F.lit("Unknown"), F.lit("unknown")
    for h, n, k in reversed(rules.HOST_SOURCES):
        src = F.when(host.contains(h), F.lit(n)).otherwise(src)
        key = F.when(host.contains(h), F.lit(k)).otherwise(key)
    return F.struct(src.alias("source"), key.alias("source_key"))


# ---------------------------------------------------------------- page -> offers
from ..functions import text as TX  # noqa: E402
from ..functions import titles as TI  # noqa: E402
from . import containers as CT  # noqa: E402

CONTAINER_SITES = [s for s, *_ in rules.SITE_LIMITS]
_ROOT = {k: (root, host) for (_o, k, _n, _p, root, host) in rules.SITES}
_NAME = {k: n for (_o, k, n, *_x) in rules.SITES}
_ORD = {k: o for (o, k, *_x) in rules.SITES}


def by_site(site: Column, fn, keys=None) -> Column:
    """CASE over the site key; only the matching site's expression runs."""
    out = None
    for k in keys or CONTAINER_SITES:
        out = F.when(site == k, fn(k)) if out is None else out.when(site == k, fn(k))
    return out


def first_link(hrefs: Column, site_key: str) -> Column:
    """First href that is site-relative, names the site host (AliExpress: or any http URL)."""
    root, host = _ROOT[site_key]
    ok = F.filter(hrefs, lambda h: h.startswith("/") | h.contains(host)
                  | (h.startswith("http") if site_key == "aliexpress" else F.lit(False)))
    h = F.get(ok, 0)
    return F.coalesce(F.when(h.startswith("/"), F.concat(F.lit(root), h)).otherwise(h), F.lit(""))


def first_image(srcs: Column, site_key: str) -> Column:
    """First image on the site host or any http URL (AliExpress: http or //, expanded)."""
    _root, host = _ROOT[site_key]
    if site_key == "aliexpress":
        s = F.get(F.filter(srcs, lambda x: x.startswith("http") | x.startswith("//")), 0)
        s = F.when(s.startswith("//"), F.concat(F.lit("https:"), s)).otherwise(s)
    else:
        s = F.get(F.filter(srcs, lambda x: x.contains(host) | x.startswith("http")), 0)
    return F.coalesce(s, F.lit(""))


def container_offers(cont: DataFrame, mode: str = "pattern") -> DataFrame:
    """E5-E7 for the container sites: text, links, title/price rules, offer gate, id."""
    site = F.col("site_key")
    text = CT.container_text(F.col("texts"))
    # rows are emitted through a one-element explode, not a filter, so the text and
    # the offer rules are evaluated once (a filter would be pushed below and re-run them)
    c = cont.select("page_id", "site_key", "url", "pos", "hrefs", "srcs",
                    F.explode(TX.if_present(text)).alias("text"))
    o = c.select(
        "page_id", "site_key", "url", "pos",
        by_site(site, lambda k: first_link(F.col("hrefs"), k)).alias("product_url"),
        by_site(site, lambda k: first_image(F.col("srcs"), k)).alias("image_url"),
        F.explode(F.array(by_site(site, lambda k: TI.site_offer_parts(F.col("text"), k, mode)))).alias("o"),
    ).filter(TI.offer_gate(F.col("o")))
    return o.select(
        offer_id(site, F.col("o.title"), F.col("pos")).alias("id"),
        "page_id", "site_key", "pos",
        F.col("o.title").alias("title"), F.col("o.price").alias("price"), "image_url",
        F.coalesce(F.nullif(F.col("product_url"), F.lit("")), F.col("url")).alias("url"),
        by_site(site, lambda k: F.lit(_NAME[k])).alias("source"),
        F.lit("ML-BERT" if mode == "pattern" else "Enhanced-Regex").alias("extraction_method"),
    )


def ebay_offers(pages: DataFrame, n: int | None = None) -> DataFrame:
    """eBay job: main text -> eBay chunks -> positional URL/image pools -> title/price
    rules -> gate; with ``n``, the first accepted offers of a page in chunk order."""
    p = pages.filter(F.col("site_key") == "ebay").select(
        "page_id", "url", F.explode(TX.if_present(TX.page_text(F.col("html")))).alias("text"),
        TX.page_pools(F.col("html"), n).alias("pool"))
    ch = TX.with_chunks(p, "text", "chunks", rule="ebay").select(
        "page_id", "url", "pool", F.posexplode("chunks").alias("pos", "chunk"))
    o = ch.select("page_id", "url", "pos",
                  F.get(F.col("pool.urls"), F.col("pos")).alias("product_url"),
                  F.get(F.col("pool.images"), F.col("pos")).alias("image_url"),
                  F.explode(F.array(TI.site_offer_parts(F.col("chunk"), "ebay"))).alias("o")) \
        .filter(TI.offer_gate(F.col("o")))
    if n is not None:
        w = Window.partitionBy("page_id").orderBy("pos")
        o = o.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    return o.select(
        offer_id(F.lit("ebay"), F.col("o.title"), F.col("pos")).alias("id"),
        "page_id", F.lit("ebay").alias("site_key"), "pos",
        F.col("o.title").alias("title"), F.col("o.price").alias("price"),
        F.coalesce(F.col("image_url"), F.lit("")).alias("image_url"),
        F.coalesce(F.col("product_url"), F.col("url")).alias("url"),
        F.lit(_NAME["ebay"]).alias("source"), F.lit(None).cast("string").alias("extraction_method"))


def extract_offers(pages: DataFrame, n: int | None = None, mode: str = "pattern") -> DataFrame:
    """All sites' offers from captured result pages (page_id, url, html, site_key).

    Container sites go through the HTML container step; eBay through text
    chunks. One stage per branch, no shuffle (with ``n``, one for eBay's accepted offers).
    """
    cont = CT.containers(pages.filter(F.col("site_key") != "ebay"), n)
    return container_offers(cont, mode).unionByName(ebay_offers(pages, n))


def drop_blob_logs(logs: DataFrame, col: str = "msg") -> DataFrame:
    """Drop log lines longer than 1000 chars that contain '/' or '+'."""
    m = F.col(col)
    blob = (F.length(m) > rules.BLOB_LOG_MIN_CHARS) & (m.contains("/") | m.contains("+"))
    return logs.filter(~F.coalesce(blob, F.lit(False)))


# Fixed value: markup that ends inside a tag, as a download leaves it that broke off.
CUT_OFF = r"<[A-Za-z/!][^<>]*$"


def page_status(pages: DataFrame) -> DataFrame:
    """Per page, 'ok', or the reason it is set aside ('empty', 'cut off inside a tag', 'no_text').

    Bad input never fails the job: every rule is a total expression (try_* casts,
    NULL-safe regexes), and split_errors() routes the set-aside rows to their own table.
    """
    t = TX.page_text(F.col("html"))
    status = (F.when(F.col("html").isNull() | (F.length("html") == 0), F.lit("empty"))
              .when(F.col("html").rlike(r"<[A-Za-z/!][^<>]*\z"), F.lit("cut off inside a tag"))
              .when(t.isNull(), F.lit("no_text")).otherwise(F.lit("ok")))
    return pages.withColumn("status", status)


def split_errors(df: DataFrame, status: str = "status", path: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(accepted rows, rejected rows, counts): one pass writes both kinds, each to its own folder of
    ``path`` (in the shared folder by default), and counts them on the way. A row is rejected if its
    ``status`` is anything but 'ok'."""
    path = path or scratch_path(df.sparkSession, "checked")
    seen = Observation()
    bad = F.col(status) != "ok"
    (df.observe(seen, F.count(F.when(~bad, 1)).alias("accepted"), F.count(F.when(bad, 1)).alias("rejected"))
     .withColumn("_kind", F.when(bad, F.lit("rejected")).otherwise(F.lit("accepted"))).write.partitionBy("_kind").parquet(path))
    read = lambda kind: df.sparkSession.read.schema(df.schema).parquet(f"{path}/_kind={kind}") if seen.get[kind] else df.sparkSession.createDataFrame([], df.schema)
    return read("accepted"), read("rejected"), dict(seen.get)


def chunk_offers(pages: DataFrame, budget: int | None = None) -> DataFrame:
    """Generic extractor over pages (page_id, url, html, query).

    Main text -> line chunks (the first ``budget``, if given) -> relevance gate
    (>= 0.3) -> entities -> offer; the i-th chunk takes
    the i-th product link / image of the page (page URL / '' past the end; i counts
    chunks before any filtering); valid if title > 5 chars and price > 0; source
    from the page URL.
    """
    from ..functions import entities as EN
    from ..functions.relevance import relevance
    p = pages.select("page_id", "url", "query", F.explode(TX.if_present(TX.page_text(F.col("html")))).alias("text"),
                     TX.page_links(F.col("html"), F.col("url")).alias("links"),
                     TX.page_images(F.col("html")).alias("images"))
    c = TX.with_chunks(p, "text", "chunks").select(
        "page_id", "url", "query", "links", "images", F.posexplode("chunks").alias("pos", "chunk"))
    c = c.filter(F.lit(True) if budget is None else F.col("pos") < budget).select(
        "*", F.explode(TX.if_present(let(relevance(F.col("chunk"), F.col("query")),
                                         lambda r: F.when(r >= rules.RELEVANCE_MIN, r)))).alias("rel"))
    valid = lambda o: F.when((F.length(o["title"]) > 5) & (o["price"] > 0), o)
    c = c.select("*", F.explode(TX.if_present(let(EN.entity_offer(F.col("chunk")), valid))).alias("o"))
    src = identify_source(F.col("url"))
    return c.select(
        offer_id(src["source_key"], F.col("o.title"), F.col("pos")).alias("id"), "page_id", "pos",
        F.col("o.title").alias("title"), F.col("o.price").alias("price"), F.col("o.currency").alias("currency"),
        F.col("o.description").alias("description"),
        F.coalesce(F.get(F.col("links"), F.col("pos")), F.col("url")).alias("url"),
        F.coalesce(F.get(F.col("images"), F.col("pos")), F.lit("")).alias("image_url"),
        src["source"].alias("source"), src["source_key"].alias("source_key"), "rel")
