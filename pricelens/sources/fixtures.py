"""Adapters from the star-schema test tables to this engine's inputs.

The test tables hold no retailer pages with prices, so searches, offers, listing
texts, catalogue entries, listing pages and image-analysis responses are derived
from ``part``/``lineitem``/``supplier``/``events``. Every adapter exists twice:
as a Spark DataFrame (used by the jobs) and as SQL text (used by the DuckDB
oracle). Both spell the same rules; keep them side by side when editing.

Scale notes: ids are hashes of the row's own columns (no global row numbering,
which would funnel all rows through one task); listing pages bundle at most
``PAGE_PARTS`` parts each, so no page grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from .tables import dealt, load

# Stable order of lineitem rows (the 6-tuple is unique; FIXTURES.md).
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)
PAGE_PARTS = 40  # parts per synthetic listing page
AS_OF = "2024-01-15 12:00:00"  # "now" for the result-reuse fixtures

# Container class used for each site's listing pages, and the
# prefix words mixed into listing texts.
PAGE_CLASS = {"ebay": "s-item", "jiji": "masonry-item", "jumia": "prd",
              "tonaton": "listing-item", "aliexpress": "gallery-item"}


def hash_id(col: Column) -> Column:
    """Stable 60-bit id from a string: first 15 hex digits of md5."""
    return F.conv(F.substring(F.md5(col), 1, 15), 16, 10).cast("long")


def hash_id_sql(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 15)) AS BIGINT)"


# ---------------------------------------------------------------- sites
SITE_SCHEMA = T.StructType([
    T.StructField("site_ord", T.IntegerType(), False),
    T.StructField("site_key", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("search_prefix", T.StringType(), False),
    T.StructField("link_root", T.StringType(), False),
    T.StructField("host", T.StringType(), False),
])


def literal_rows(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A small constant table built in the JVM (``inline`` of a literal array of structs)."""
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, schema.fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def sites(spark: SparkSession) -> DataFrame:
    """The five retailers (a constant dimension of 5 rows)."""
    return literal_rows(spark, rules.SITES, SITE_SCHEMA)


def _values_sql(rows, names) -> str:
    def lit(v):
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(names)})"


SITES_SQL = _values_sql(rules.SITES, [f.name for f in SITE_SCHEMA.fields])


RATE_SCHEMA = T.StructType([T.StructField("currency", T.StringType()), T.StructField("rate", T.DoubleType())])
RATES = [("USD", rules.USD_TO_GHS), ("GHS", 1.0)]


def rates(spark: SparkSession) -> DataFrame:
    """Exchange rates to GHS."""
    return literal_rows(spark, RATES, RATE_SCHEMA)


RATES_SQL = "SELECT currency, rate::DOUBLE AS rate FROM (" + _values_sql(RATES, ["currency", "rate"]) + ") r"


# ---------------------------------------------------------------- searches
def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search per distinct part name, with a mix of filter settings."""
    names = load(spark, sf_dir, "part").select(F.col("p_name").alias("query")).distinct()
    qid = hash_id(F.col("query"))
    return names.select(
        qid.alias("query_id"),
        F.col("query"),
        F.when(qid % 4 == 0, F.lit("office")).when(qid % 4 == 1, F.lit("jewelry"))
         .when(qid % 4 == 3, F.lit("collectibles")).alias("category"),
        F.when(qid % 5 == 0, F.lit(1000.0)).cast("double").alias("min_price"),
        F.lit(50000.0).alias("max_price"),
        F.when(qid % 3 == 0, F.array(F.lit("ebay"), F.lit("jiji"), F.lit("aliexpress")))
         .otherwise(F.array().cast("array<string>")).alias("retailers"),
    )


SEARCHES_SQL = f"""
SELECT query_id, query,
       CASE WHEN query_id % 4 = 0 THEN 'office' WHEN query_id % 4 = 1 THEN 'jewelry'
            WHEN query_id % 4 = 3 THEN 'collectibles' END AS category,
       CASE WHEN query_id % 5 = 0 THEN 1000.0 END::DOUBLE AS min_price,
       50000.0::DOUBLE AS max_price,
       CASE WHEN query_id % 3 = 0 THEN ['ebay', 'jiji', 'aliexpress'] ELSE []::VARCHAR[] END AS retailers
FROM (SELECT {hash_id_sql('query')} AS query_id, query
      FROM (SELECT DISTINCT p_name AS query FROM part) d) q"""


# ---------------------------------------------------------------- offers
def offer_title(name: Column, brand: Column, ptype: Column) -> Column:
    return F.concat_ws(" ", name, F.replace(brand, F.lit("#"), F.lit(" ")), ptype)


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem as an offer of its part, on the site ``l_suppkey % 5``.

    Columns: query_id, query, title, price, url, last_updated, site_ord, site_key,
    source, plus the lineitem order key (the stable tie order inside a site).
    """
    # A search's id is a function of its query, the part name: no join with the searches.
    p = load(spark, sf_dir, "part").where("p_name IS NOT NULL").select(
        "p_partkey", hash_id(F.col("p_name")).alias("query_id"), F.col("p_name").alias("query"), "p_brand", "p_type")
    li = dealt(load(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_shipdate"))
    st = F.broadcast(sites(spark).select("site_ord", "site_key", "source"))  # 5 rows
    o = (li.join(p, F.col("l_partkey") == F.col("p_partkey"))
         .join(st, (F.col("l_suppkey") % 5).cast("int") == F.col("site_ord")))
    return o.select(
        "query_id", "query",
        offer_title(F.col("query"), F.col("p_brand"), F.col("p_type")).alias("title"),
        F.col("l_extendedprice").alias("price"),
        F.concat(F.lit("https://shop.example.com/item/"), F.col("l_partkey").cast("string")).alias("url"),
        F.col("l_shipdate").alias("last_updated"),
        "site_ord", "site_key", "source", *LINE_ORDER,
    )


OFFERS_SQL = f"""
SELECT s.query_id, s.query, concat_ws(' ', p_name, replace(p_brand, '#', ' '), p_type) AS title,
       l_extendedprice AS price,
       'https://shop.example.com/item/' || CAST(l_partkey AS VARCHAR) AS url,
       l_shipdate AS last_updated, t.site_ord, t.site_key, t.source, {LINE_ORDER_SQL}
FROM lineitem JOIN part ON p_partkey = l_partkey
JOIN searches s ON s.query = p_name
JOIN sites t ON t.site_ord = l_suppkey % 5"""


# ---------------------------------------------------------------- listing texts
def listing_text_expr(partkey: Column, name: Column, brand: Column, ptype: Column, retail: Column) -> Column:
    amount = retail.cast("decimal(12,2)").cast("string")
    prefix = F.when(partkey % 4 == 0, F.lit("Popular ")).when(partkey % 4 == 1, F.lit("New ")).otherwise(F.lit(""))
    price = (F.when(partkey % 5 == 0, F.concat(F.lit("₵ "), amount))
             .when(partkey % 5 == 1, F.concat(F.lit("GH₵"), amount))
             .when(partkey % 5 == 2, F.concat(F.lit("$"), amount))
             .when(partkey % 5 == 3, F.concat(F.lit("USD "), amount))
             .otherwise(F.lit("ask seller")))
    return F.concat(prefix, offer_title(name, brand, ptype), F.lit(" "), price)


def listing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short listing text per part: optional prefix word, title, price in one of five styles."""
    p = dealt(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"))
    return p.select(F.col("p_partkey").alias("id"),
                    listing_text_expr(F.col("p_partkey"), F.col("p_name"), F.col("p_brand"),
                                      F.col("p_type"), F.col("p_retailprice")).alias("text"))


LISTING_TEXT_EXPR_SQL = """concat(CASE p_partkey % 4 WHEN 0 THEN 'Popular ' WHEN 1 THEN 'New ' ELSE '' END,
    concat_ws(' ', p_name, replace(p_brand, '#', ' '), p_type), ' ',
    CASE p_partkey % 5
      WHEN 0 THEN '₵ ' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)
      WHEN 1 THEN 'GH₵' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)
      WHEN 2 THEN '$' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)
      WHEN 3 THEN 'USD ' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)
      ELSE 'ask seller' END)"""
LISTING_TEXT_SQL = f"SELECT p_partkey AS id, {LISTING_TEXT_EXPR_SQL} AS text FROM part"


# ---------------------------------------------------------------- catalogue
def price_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upsert feed: every lineitem is a price observation of (part, supplier)."""
    li = load(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_shipdate")
    return li.select(
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_suppkey").alias("source_id"),
        F.col("l_extendedprice").alias("price"),
        F.concat(F.lit("https://shop.example.com/item/"), F.col("l_partkey").cast("string")).alias("url"),
        F.col("l_shipdate").alias("last_updated"),
        *LINE_ORDER,
    )


PRICE_FEED_SQL = f"""
SELECT CAST(l_partkey AS VARCHAR) AS product_id, l_suppkey AS source_id, l_extendedprice AS price,
       'https://shop.example.com/item/' || CAST(l_partkey AS VARCHAR) AS url,
       l_shipdate AS last_updated, {LINE_ORDER_SQL}
FROM lineitem"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue products from ``part``."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return p.select(
        F.col("p_partkey").cast("string").alias("product_id"),
        offer_title(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("name"),
        F.concat(F.lit("https://img.example.com/product/"), F.col("p_partkey").cast("string"),
                 F.lit(".jpg")).alias("image_url"),
    )


PRODUCTS_SQL = """
SELECT CAST(p_partkey AS VARCHAR) AS product_id,
       concat_ws(' ', p_name, replace(p_brand, '#', ' '), p_type) AS name,
       'https://img.example.com/product/' || CAST(p_partkey AS VARCHAR) || '.jpg' AS image_url
FROM part"""


def catalog_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue sources from ``supplier``."""
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return s.select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"),
                    F.concat(F.lit("https://"), F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("-"))),
                             F.lit(".example.com")).alias("url"))


CATALOG_SOURCES_SQL = """
SELECT s_suppkey AS source_id, s_name AS name,
       'https://' || lower(replace(s_name, '#', '-')) || '.example.com' AS url
FROM supplier"""


# ---------------------------------------------------------------- listing pages
def _fragment(site_key: Column, pid: Column, text: Column) -> Column:
    ids = pid.cast("string")
    cls = F.lit("")
    for k, v in PAGE_CLASS.items():
        cls = F.when(site_key == k, F.lit(v)).otherwise(cls)
    link = F.when(site_key == "ebay", F.concat(F.lit("https://www.ebay.com/itm/"), ids)) \
        .otherwise(F.concat(F.lit("/item/"), ids, F.lit(".html")))
    img = F.when(site_key == "ebay", F.concat(F.lit("https://i.ebayimg.com/images/"), ids, F.lit(".jpg"))) \
        .otherwise(F.concat(F.lit("https://img.example.com/product/"), ids, F.lit(".jpg")))
    return F.concat(F.lit('<div class="'), cls, F.lit('"><div><a href="'), link, F.lit('">'), text,
                    F.lit('</a></div>'), F.when(pid % 3 == 0, F.concat(F.lit('<span>\n· offer </span><p><a href="/more/'), ids, F.lit('">more</a></p>'))).otherwise(F.lit("")),
                    F.lit('<img src="'), img, F.lit('">'), F.when(pid % 3 == 0, F.lit('<img src="/thumb.png">')).otherwise(F.lit("")), F.lit('</div>\n'))


PAGE_HEAD = ("<html><head><style>.x{color:red}</style><script>var price = '$1';</script></head>"
             "<body><nav><a href=\"/\">Home</a> <a href=\"/deals\">Deals</a></nav>\n<h1>Results</h1>\n"
             "<div class=\"menu\"><a href=\"/c/phones\">Phones</a> | <a href=\"/c/rings\"><p>Rings</p><p>and bolts</p></a></div><p>See <a href=\"/c/new\">new</a>: 12</p>\n")
PAGE_TAIL = "<footer>Contact us</footer></body></html>"


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retailer result pages: parts bundled ``PAGE_PARTS`` at a time, each page
    assigned to a site (page_key % 5) and rendered with that site's markup."""
    lt = listing_text(spark, sf_dir)
    pk = F.floor(F.col("id") / PAGE_PARTS)
    st = F.broadcast(sites(spark).select("site_ord", "site_key", "search_prefix"))
    frags = (lt.withColumn("page_id", pk)
             .join(st, (F.col("page_id") % 5).cast("int") == F.col("site_ord"))
             .select("page_id", "site_key", "search_prefix", "id", F.col("text").alias("first_text"),
                     _fragment(F.col("site_key"), F.col("id"), F.col("text")).alias("frag")))
    pages = frags.groupBy("page_id", "site_key", "search_prefix").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "frag"))), lambda x: x["frag"]),
                     "").alias("body"), F.min_by("first_text", "id").alias("first_text"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.concat(F.col("search_prefix"), F.lit("page"), F.col("page_id").cast("string")).alias("url"),
        F.concat(F.lit(PAGE_HEAD), F.col("body"), F.lit(PAGE_TAIL)).alias("html"),
        "site_key", "first_text",
    )


def _sql_text(text: str) -> str:
    """SQL literal of a text that may hold quotes and newlines."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _fragment_sql() -> str:
    cls = "CASE t.site_key " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PAGE_CLASS.items()) + " END"
    return (f"""'<div class="' || {cls} || '"><div><a href="' ||
       CASE WHEN t.site_key = 'ebay' THEN 'https://www.ebay.com/itm/' || CAST(id AS VARCHAR)
            ELSE '/item/' || CAST(id AS VARCHAR) || '.html' END || '">' || text ||
       '</a></div>' || CASE WHEN id % 3 = 0 THEN '<span>' || chr(10) || '· offer </span><p><a href="/more/' || CAST(id AS VARCHAR) || '">more</a></p>' ELSE '' END ||
       '<img src="' ||
       CASE WHEN t.site_key = 'ebay' THEN 'https://i.ebayimg.com/images/' || CAST(id AS VARCHAR) || '.jpg'
            ELSE 'https://img.example.com/product/' || CAST(id AS VARCHAR) || '.jpg' END ||
       '">' || CASE WHEN id % 3 = 0 THEN '<img src="/thumb.png">' ELSE '' END || '</div>' || chr(10)""")


LISTING_PAGES_SQL = f"""
SELECT CAST(page_id AS BIGINT) AS page_id, search_prefix || 'page' || CAST(page_id AS VARCHAR) AS url,
       {_sql_text(PAGE_HEAD)} || string_agg(frag, '' ORDER BY id) ||
       '{PAGE_TAIL}' AS html, site_key, arg_min(text, id) AS first_text
FROM (SELECT CAST(floor(lt.id / {PAGE_PARTS}) AS BIGINT) AS page_id, t.site_key, t.search_prefix, lt.id,
             {_fragment_sql()} AS frag
      , lt.text FROM listing_text lt JOIN sites t ON t.site_ord = CAST(floor(lt.id / {PAGE_PARTS}) AS BIGINT) % 5) f
GROUP BY page_id, site_key, search_prefix"""


# ---------------------------------------------------------------- image analyses
def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored image-analysis responses (JSON text), with malformed and edge rows."""
    p = dealt(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    k = F.col("p_partkey")
    conf = (F.when(k % 17 == 0, F.lit("-1")).when(k % 19 == 0, F.lit("2"))
            .otherwise(((F.col("p_size") % 20) * 0.05).cast("decimal(6,2)").cast("string")))
    brand = F.when(k % 7 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), F.col("p_brand"), F.lit('"')))
    name = F.when(k % 13 == 0, F.lit('""')).otherwise(F.concat(F.lit('"'), F.col("p_name"), F.lit('"')))
    body = F.concat(
        F.lit('{"product_name": '), name,
        F.lit(', "category": "'), F.col("p_type"),
        F.lit('", "brand": '), brand,
        F.lit(', "features": ["'), F.col("p_type"), F.lit('", "size '), F.col("p_size").cast("string"),
        F.lit('", "'), F.lower(F.col("p_type")), F.lit('"], "search_terms": ["'), F.col("p_name"),
        F.lit('", "'), F.replace(F.col("p_brand"), F.lit("#"), F.lit(" ")),
        F.lit('"], "confidence": '), conf, F.lit("}"))
    resp = F.when(k % 11 == 0, F.lit("not json {")).when(k % 23 == 0, F.lit("")).otherwise(body)
    return p.select(k.alias("image_id"), resp.alias("response"))


ANALYSES_SQL = """
SELECT p_partkey AS image_id,
  CASE WHEN p_partkey % 11 = 0 THEN 'not json {' WHEN p_partkey % 23 = 0 THEN '' ELSE
  '{"product_name": ' || CASE WHEN p_partkey % 13 = 0 THEN '""' ELSE '"' || p_name || '"' END ||
  ', "category": "' || p_type ||
  '", "brand": ' || CASE WHEN p_partkey % 7 = 0 THEN 'null' ELSE '"' || p_brand || '"' END ||
  ', "features": ["' || p_type || '", "size ' || CAST(p_size AS VARCHAR) || '", "' || lower(p_type) ||
  '"], "search_terms": ["' || p_name || '", "' || replace(p_brand, '#', ' ') ||
  '"], "confidence": ' ||
  CASE WHEN p_partkey % 17 = 0 THEN '-1' WHEN p_partkey % 19 = 0 THEN '2'
       ELSE CAST(CAST((p_size % 20) * 0.05 AS DECIMAL(6,2)) AS VARCHAR) END || '}' END AS response
FROM part"""


# ---------------------------------------------------------------- result store
def result_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached search results: key from event type and user, time = event time."""
    e = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        F.lower(F.trim(F.concat_ws("_", F.col("event_type"), F.col("user_id").cast("string")))).alias("cache_key"),
        F.col("ts").alias("cached_at"), F.col("value").alias("payload"), "event_id")


RESULT_STORE_SQL = """
SELECT lower(trim(event_type || '_' || CAST(user_id AS VARCHAR))) AS cache_key, ts AS cached_at,
       value AS payload, event_id FROM events"""


FIXTURE_SQL = {
    "sites": SITES_SQL,
    "rates": RATES_SQL,
    "searches": SEARCHES_SQL,
    "offers": OFFERS_SQL,
    "listing_text": LISTING_TEXT_SQL,
    "price_feed": PRICE_FEED_SQL,
    "products": PRODUCTS_SQL,
    "catalog_sources": CATALOG_SOURCES_SQL,
    "listing_pages": LISTING_PAGES_SQL,
    "analyses": ANALYSES_SQL,
    "result_store": RESULT_STORE_SQL,
}
FIXTURE_DEPS = {
    "offers": ["sites", "searches"],
    "listing_pages": ["sites", "listing_text"],
}


def with_fixtures(names: list[str], body: str) -> str:
    """Prefix ``body`` with the CTEs of the named fixtures (and what they need)."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in FIXTURE_DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)
    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n]})" for n in order)
    if not ctes:
        return body
    b = body.lstrip()
    if b[:5].upper() == "WITH ":  # merge the body's own CTEs after the fixtures
        return f"WITH {ctes},\n{b[5:]}"
    return f"WITH {ctes}\n{body}"


# ---------------------------------------------------------------- constant dimensions
CAT_KW_SQL = _values_sql([(c, w) for c, ws in rules.CATEGORY_KEYWORDS.items() for w in ws],
                         ["category", "keyword"])
SITE_NAMES_SQL = _values_sql([(s[1], s[2]) for s in rules.SITES], ["site_key", "source"])
FIXTURE_SQL["cat_kw"] = CAT_KW_SQL
FIXTURE_SQL["site_names"] = SITE_NAMES_SQL
