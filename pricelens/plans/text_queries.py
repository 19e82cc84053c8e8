"""Page and document text queries (S1, E1-E9b, E17, E18) and the page -> offer jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as TX
from ..operators import containers as CT
from ..operators import extract as X
from ..sources import fixtures as fx
from ..sources import readers
from ..sources.tables import load
from .registry import query

# ---------------------------------------------------------------- SQL spellings

_NL = "chr(10)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def clean_html_sql(x: str) -> str:
    h = x
    for t in ["script", "style"]:
        h = f"regexp_replace({h}, '(?is)<{t}[^>]*>.*?</{t}>', '', 'g')"
    return _strip(f"regexp_replace({h}, '\\s+', ' ', 'g')")


def main_text_sql(x: str) -> str:
    """Main text; a line goes if it is short and more than half of its characters are inside links."""
    h = f"regexp_replace(translate({x}, chr(1) || chr(2), ''), '(?is)<head[^>]*>.*?</head>|<!--.*?-->', '', 'g')"
    for t in TX.BOILERPLATE_TAGS:
        h = f"regexp_replace({h}, '(?is)<{t}\\b[^>]*>.*?</{t}>', '', 'g')"
    h = f"regexp_replace(regexp_replace({h}, '(?i)<a\\b[^>]*>', chr(1), 'g'), '(?i)</a\\s*>', chr(2), 'g')"
    h = f"regexp_replace({h}, '(?i)</?(?:{TX._BLOCK_TAGS})\\b[^>]*>', {_NL}, 'g')"
    h = f"regexp_replace({h}, '<[^>]*>', '', 'g')"
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"),
                    ("&nbsp;", " "), ("&amp;", "&")]:
        h = f"replace({h}, '{ent}', '{ch}')"
    parts = (f"list_transform(string_split({h}, chr(1)), lambda p, i: CASE WHEN i > 1 AND contains(p, chr(2)) THEN "
             f"replace(substr(p, 1, strpos(p, chr(2)) - 1), {_NL}, chr(2) || {_NL} || chr(1)) || substr(p, strpos(p, chr(2))) ELSE p END)")
    blank = "regexp_replace({}, '[ \\t\\r\\f\\x0B]+', '', 'g')"
    plain = "translate(ln, chr(1) || chr(2), '')"
    linked = "array_to_string(regexp_extract_all(ln, '\\x01([^\\x01\\x02]*)\\x02', 1), '')"
    text = _strip(f"regexp_replace({plain}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')")
    lines = (f"list_filter(list_transform(string_split(array_to_string({parts}, chr(1)), {_NL}), lambda ln: struct_pack(t := {text}, "
             f"n := length({blank.format(plain)}), k := length({blank.format(linked)}))), "
             f"lambda s: s.t <> '' AND NOT (length(s.t) < {TX.LINK_LINE_CHARS} AND 2 * s.k > s.n))")
    return f"array_to_string(list_transform({lines}, lambda s: s.t), {_NL})"


def url_join_sql(base: str, ref: str) -> str:
    scheme = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)"
    origin = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    no_frag = f"regexp_extract({base}, '^([^#]*)', 1)"
    no_query = f"regexp_extract({base}, '^([^?#]*)', 1)"
    path = f"regexp_extract({no_query}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$', 1)"
    dir_ = f"regexp_extract({path}, '^(.*/)', 1)"
    return (f"CASE WHEN regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {ref} "
            f"WHEN starts_with({ref}, '//') THEN {scheme} || ':' || {ref} "
            f"WHEN starts_with({ref}, '/') THEN {origin} || {ref} "
            f"WHEN starts_with({ref}, '?') THEN {no_query} || {ref} "
            f"WHEN starts_with({ref}, '#') THEN {no_frag} || {ref} "
            f"WHEN {ref} = '' THEN {base} "
            f"ELSE {origin} || CASE WHEN {dir_} = '' THEN '/' ELSE {dir_} END || {ref} END")


def _re(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _explode_sql(list_expr: str, key: str, name: str, table: str) -> str:
    return f"""SELECT {key}, CAST(i - 1 AS INTEGER) AS pos, v AS {name} FROM (
  SELECT {key}, unnest(L) AS v, generate_subscripts(L, 1) AS i FROM (SELECT {key}, {list_expr} AS L FROM {table}) a) b"""


_LINKS_SQL = ("list_concat(" + ", ".join(f"regexp_extract_all(html, {_re('(?i)' + p)}, 1)" for p in rules.PAGE_LINK_PATTERNS)
              + ")")
_LINKS_SQL = f"list_transform({_LINKS_SQL}, lambda u: {url_join_sql('url', 'u')})"
_LINKS_SQL = f"list_filter({_LINKS_SQL}, lambda x, i: list_position({_LINKS_SQL}, x) = i)"
_IMGS_SQL = ("list_filter(list_concat(" + ", ".join(f"regexp_extract_all(html, {_re('(?i)' + p)}, 1)"
                                                   for p in rules.PAGE_IMAGE_PATTERNS)
             + "), lambda u: contains(lower(u), 'product') OR contains(lower(u), 'item'))")


def _pool_sql() -> tuple[str, str]:
    urls = f"regexp_extract_all(html, {_re(rules.EBAY_ITEM_URL)}, 0)"
    imgs = f"regexp_extract_all(html, {_re(rules.EBAY_IMAGE_URL)}, 0)"
    urls = f"CASE WHEN len({urls}) > 0 THEN {urls} ELSE regexp_extract_all(html, {_re(rules.ANY_HTTPS_URL)}, 0) END"
    imgs = f"CASE WHEN len({imgs}) > 0 THEN {imgs} ELSE regexp_extract_all(html, {_re(rules.ANY_IMAGE_URL)}, 0) END"
    return f"list_concat({urls}, {urls})", f"list_concat({imgs}, {imgs})"


# ---------------------------------------------------------------- oracles for the folds
def _lines_sql(x: str) -> str:
    return (f"list_filter(list_transform(string_split({x}, {_NL}), lambda ln: {_strip('ln')}), "
            f"lambda ln: length(ln) > 0)")


def _chunks_sql(lines: str, rule: str) -> str:
    """SQL fold over a line list (column reference): the same boundary rule as the Spark fold."""
    if rule == "ebay":
        flag = f"regexp_matches({lines}[i], {_re(rules.EBAY_CHUNK_PRICE)})"
        max_len, close_over = None, rules.EBAY_CHUNK_MAX
    else:
        ind = "|".join(__import__("re").escape(w) for w in rules.GENERIC_CHUNK_INDICATORS)
        flag = (f"(regexp_matches(lower({lines}[i]), {_re(rules.GENERIC_CHUNK_PRICE)}) "
                f"OR regexp_matches(lower({lines}[i]), {_re(ind)}))")
        max_len, close_over = rules.GENERIC_CHUNK_MAX, None
    items = f"list_transform(range(1, len({lines}) + 1), lambda i: struct_pack(l := length({lines}[i]), f := {flag}))"
    len2 = "CASE WHEN acc.n = 0 THEN x.l ELSE acc.len + 1 + x.l END"
    trig = f"(x.f OR {len2} > {close_over})" if close_over is not None else "x.f"
    close = f"(acc.n + 1 >= 2 AND {trig})"
    over = f"(NOT {close} AND {len2} > {max_len})" if max_len is not None else "FALSE"
    reset = f"({close} OR {over})"
    step = (f"struct_pack(i := acc.i + 1, s := CASE WHEN {reset} THEN acc.i + 1 ELSE acc.s END, "
            f"n := CASE WHEN {reset} THEN 0 ELSE acc.n + 1 END, len := CASE WHEN {reset} THEN 0 ELSE {len2} END, "
            f"b := CASE WHEN {reset} THEN list_append(acc.b, struct_pack(s := acc.s, e := acc.i + 1)) ELSE acc.b END)")
    init = ("struct_pack(i := 0::BIGINT, s := 0::BIGINT, n := 0::BIGINT, len := 0::BIGINT, "
            "b := []::STRUCT(s BIGINT, e BIGINT)[])")
    fold = f"list_reduce({items}, lambda acc, x: {step}, {init})"
    fin = (f"CASE WHEN f.n > 0 THEN list_append(f.b, struct_pack(s := f.s, e := f.s + f.n)) "
           f"ELSE f.b END")
    return fold, fin


def _chunk_query_sql(src: str, rule: str) -> str:
    fold, fin = _chunks_sql("ls", rule)
    return f"""SELECT page_id, CAST(k - 1 AS INTEGER) AS chunk_no, array_to_string(ls[c.s + 1:c.e], {_NL}) AS chunk FROM (
  SELECT page_id, ls, unnest(bnd) AS c, generate_subscripts(bnd, 1) AS k FROM (
    SELECT page_id, ls, {fin} AS bnd FROM (SELECT page_id, ls, {fold} AS f FROM (
      SELECT page_id, {_lines_sql('text')} AS ls FROM ({src}) s) a) b) c) d"""


_LP_TEXT = f"SELECT page_id, {main_text_sql('html')} AS text FROM listing_pages"
_RAW_TEXT = f"SELECT -page_id - 1 AS page_id, {main_text_sql('html')} AS text FROM pages"
_TEXT_OK = "SELECT * FROM ({}) t WHERE length(text) >= 1"
ORACLE_CHUNKS = _chunk_query_sql(
    _TEXT_OK.format(_LP_TEXT) + " UNION ALL " + _TEXT_OK.format(_RAW_TEXT), "generic")
ORACLE_CHUNKS_EBAY = _chunk_query_sql(_TEXT_OK.format(_LP_TEXT), "ebay")

_L = rules.WINDOW_TOKENS * rules.WINDOW_CHARS_PER_TOKEN
_SUB = f"substr(d.text, w.st + 1, {_L})"
_LSP = f"CASE WHEN strpos({_SUB}, ' ') = 0 THEN 0 ELSE length({_SUB}) - strpos(reverse({_SUB}), ' ') + 1 END"
_END = f"CASE WHEN w.st + {_L} >= w.n THEN w.n WHEN {_LSP} > 1 THEN w.st + {_LSP} - 1 ELSE w.st + {_L} END"
def windows_sql(src: str, key: str = "doc_id") -> str:
    """Fixed windows of ``src(key, text)`` as a recursive CTE over start offsets
    (last space strictly after the start, the next window starts at it; a tail that fits is whole)."""
    return f"""WITH RECURSIVE src AS ({src}), w({key}, n, st, k) AS (
    SELECT {key}, length(text), 0::BIGINT, 0 FROM src
    UNION ALL
    SELECT w.{key}, w.n, {_END}, w.k + 1 FROM w JOIN src d ON d.{key} = w.{key} WHERE {_END} < w.n)
  SELECT w.{key}, CAST(w.k AS INTEGER) AS chunk_no, CAST({_END} - w.st AS INTEGER) AS n_chars,
         substr(d.text, w.st + 1, {_END} - w.st) AS chunk
  FROM w JOIN src d ON d.{key} = w.{key}"""


ORACLE_WINDOWS = windows_sql("SELECT doc_id, text FROM documents")


# ---------------------------------------------------------------- queries
@query("scan_pages", sql="SELECT page_id, url, CAST(length(html) AS BIGINT) AS n_chars FROM pages WHERE length(html) > 0")
def scan_pages(spark, sf_dir):
    """Captured pages with a body."""
    p = readers.read_pages(spark, sf_dir)
    return p.select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@query("clean_html", sql=f"SELECT page_id, {clean_html_sql('html')} AS cleaned FROM pages")
def clean_html(spark, sf_dir):
    """Scripts and styles removed, whitespace collapsed."""
    return load(spark, sf_dir, "pages").select("page_id", TX.clean_html(F.col("html")).alias("cleaned"))


@query("page_text", sql=f"""SELECT page_id, t AS text, CAST(len(string_split(t, {_NL})) AS INTEGER) AS n_lines FROM
  (SELECT page_id, {main_text_sql('html')} AS t FROM (SELECT page_id, html FROM pages UNION ALL SELECT -page_id - 1, html FROM listing_pages) p) x
  WHERE length(t) >= 1""", fixtures=["listing_pages"])
def page_text(spark, sf_dir):
    """Main text of each raw page and of each listing page (with its menus) as lines; pages without text are skipped."""
    p = load(spark, sf_dir, "pages").select("page_id", "html").unionByName(
        fx.listing_pages(spark, sf_dir).select((-F.col("page_id") - 1).alias("page_id"), "html"))
    p = p.select("page_id", F.explode(TX.if_present(TX.page_text(F.col("html")))).alias("text"))
    return p.select("page_id", "text", F.size(F.split("text", "\n")).alias("n_lines"))


@query("window_chunks", sql=ORACLE_WINDOWS)
def window_chunks(spark, sf_dir):
    """Whole documents cut into fixed windows (<= 1536 chars, broken at spaces)."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(TX.window_chunks(F.col("text"))).alias("chunk_no", "chunk")) \
        .select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), "chunk")


@query("page_links", sql=_explode_sql(_LINKS_SQL, "page_id", "link", "listing_pages"), fixtures=["listing_pages"])
def page_links(spark, sf_dir):
    """Product-like links of each page, resolved, de-duplicated in order."""
    p = fx.listing_pages(spark, sf_dir)
    return p.select("page_id", F.posexplode(TX.page_links(F.col("html"), F.col("url"))).alias("pos", "link"))


@query("page_images", sql=_explode_sql(_IMGS_SQL, "page_id", "image", "listing_pages"), fixtures=["listing_pages"])
def page_images(spark, sf_dir):
    """Product-like images of each page (no de-duplication)."""
    p = fx.listing_pages(spark, sf_dir)
    return p.select("page_id", F.posexplode(TX.page_images(F.col("html"))).alias("pos", "image"))


_PU, _PI = _pool_sql()


@query("page_pools", sql=f"""{_explode_sql(_PU, 'page_id', 'value', 'listing_pages')}
  UNION ALL {_explode_sql(_PI, 'page_id', 'value', 'listing_pages')}""".replace(
    "SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, v AS value FROM (", "SELECT page_id, 'url' AS kind, CAST(i - 1 AS INTEGER) AS pos, v AS value FROM (", 1).replace(
    "UNION ALL SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, v AS value FROM (", "UNION ALL SELECT page_id, 'image' AS kind, CAST(i - 1 AS INTEGER) AS pos, v AS value FROM ("),
       fixtures=["listing_pages"])
def page_pools(spark, sf_dir):
    """eBay URL and image pools used for positional pairing."""
    p = fx.listing_pages(spark, sf_dir).select("page_id", TX.page_pools(F.col("html")).alias("pool"))
    u = p.select("page_id", F.lit("url").alias("kind"), F.posexplode("pool.urls").alias("pos", "value"))
    i = p.select("page_id", F.lit("image").alias("kind"), F.posexplode("pool.images").alias("pos", "value"))
    return u.unionByName(i)


def _listing_page_text(spark, sf_dir):
    return fx.listing_pages(spark, sf_dir).select(
        "page_id", "site_key", F.explode(TX.if_present(TX.page_text(F.col("html")))).alias("text"))


@query("product_chunks", sql=ORACLE_CHUNKS, fixtures=["listing_pages"])
def product_chunks(spark, sf_dir):
    """Generic line chunker over the main text of listing pages and of raw pages."""
    lp = _listing_page_text(spark, sf_dir).select("page_id", "text")
    raw = load(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("page_id"),
                                              F.explode(TX.if_present(TX.page_text(F.col("html")))).alias("text"))
    c = TX.with_chunks(lp.unionByName(raw), "text", "chunks")
    return c.select("page_id", F.posexplode("chunks").alias("chunk_no", "chunk"))


@query("product_chunks_ebay", sql=ORACLE_CHUNKS_EBAY, fixtures=["listing_pages"])
def product_chunks_ebay(spark, sf_dir):
    """eBay line chunker over listing page text."""
    lp = _listing_page_text(spark, sf_dir)
    c = TX.with_chunks(lp, "text", "chunks", rule="ebay")
    return c.select("page_id", F.posexplode("chunks").alias("chunk_no", "chunk"))


def _containers(spark, sf_dir):
    pages = fx.listing_pages(spark, sf_dir).filter(F.col("site_key") != "ebay")
    return CT.containers(pages)


# Oracles of the container jobs: a listing page is its fragments in id order, each fragment is one
# container with a text, a link and an image (every third with more of each, nested deeper); the scripts, menu and
# footer around are none.
_FRAGMENTS_SQL = f"""SELECT CAST(id // {fx.PAGE_PARTS} AS BIGINT) AS page_id, t.site_key, t.link_root, t.source,
  t.search_prefix || 'page' || CAST(id // {fx.PAGE_PARTS} AS VARCHAR) AS page_url, lt.id AS part, CASE WHEN lt.id % 3 = 0 THEN lt.text || ' | · offer | more' ELSE lt.text END AS text,
  CAST(row_number() OVER (PARTITION BY id // {fx.PAGE_PARTS} ORDER BY id) - 1 AS INTEGER) AS pos,
  t.link_root || '/item/' || CAST(id AS VARCHAR) || '.html' AS product_url,
  'https://img.example.com/product/' || CAST(id AS VARCHAR) || '.jpg' AS image_url
  FROM listing_text lt JOIN sites t ON t.site_ord = (id // {fx.PAGE_PARTS}) % 5 WHERE t.site_key <> 'ebay'"""


def _extract_offers_sql() -> str:
    from . import sql_rules as SR
    def per_site(i: int) -> str:
        return "CASE site_key " + " ".join(f"WHEN '{k}' THEN {SR.site_offer('text', k)[i]}" for k in X.CONTAINER_SITES) + " END"
    ok, title, price = SR.site_offer("chunk", "ebay")
    urls, images = _pool_sql()
    return f"""SELECT site_key || '_' || substr(sha256(title || CAST(pos AS VARCHAR)), 1, 16) AS id, page_id, site_key, pos, title,
    price, image_url, product_url AS url, source, 'ML-BERT' AS extraction_method
  FROM (SELECT *, {per_site(0)} AS ok, {per_site(1)} AS title, {per_site(2)} AS price FROM ({_FRAGMENTS_SQL}) f) c WHERE ok
  UNION ALL
  SELECT 'ebay_' || substr(sha256(title || CAST(pos AS VARCHAR)), 1, 16), page_id, 'ebay', pos, title, price,
    coalesce(images[pos + 1], ''), coalesce(urls[pos + 1], url), (SELECT source FROM sites WHERE site_key = 'ebay'), NULL
  FROM (SELECT page_id, chunk_no AS pos, url, urls, images, {ok} AS ok, {title} AS title, {price} AS price
        FROM ({ORACLE_CHUNKS_EBAY}) k JOIN (SELECT page_id, url, {urls} AS urls, {images} AS images FROM listing_pages
                                            WHERE site_key = 'ebay') p USING (page_id)) e WHERE ok"""


@query("containers", sql=f"""SELECT page_id, site_key, pos, (CASE WHEN part % 3 = 0 THEN 3 ELSE 1 END)::INTEGER AS n_texts,
  (CASE WHEN part % 3 = 0 THEN 2 ELSE 1 END)::INTEGER AS n_links, (CASE WHEN part % 3 = 0 THEN 2 ELSE 1 END)::INTEGER AS n_images
  FROM ({_FRAGMENTS_SQL}) f""", fixtures=["listing_text", "sites"])
def containers(spark, sf_dir):
    """The product containers of each listing page under its site's selector cascade."""
    return _containers(spark, sf_dir).select("page_id", "site_key", "pos", F.size("texts").alias("n_texts"),
                                             F.size("hrefs").alias("n_links"), F.size("srcs").alias("n_images"))


@query("container_text", sql=f"SELECT page_id, pos, text FROM ({_FRAGMENTS_SQL}) f", fixtures=["listing_text", "sites"])
def container_text(spark, sf_dir):
    """E5: container text (' | '-joined)."""
    c = _containers(spark, sf_dir)
    return c.select("page_id", "pos", CT.container_text(F.col("texts")).alias("text"))


@query("container_links", sql=f"SELECT page_id, pos, product_url, image_url FROM ({_FRAGMENTS_SQL}) f", fixtures=["listing_text", "sites"])
def container_links(spark, sf_dir):
    """First acceptable product link and image of each container."""
    c = _containers(spark, sf_dir)
    return c.select("page_id", "pos",
                    X.by_site(F.col("site_key"), lambda k: X.first_link(F.col("hrefs"), k)).alias("product_url"),
                    X.by_site(F.col("site_key"), lambda k: X.first_image(F.col("srcs"), k)).alias("image_url"))


@query("extract_offers", sql=_extract_offers_sql(), fixtures=["listing_text", "listing_pages", "sites"])
def extract_offers(spark, sf_dir):
    """Full per-site offer extraction from listing pages (pattern mode)."""
    return X.extract_offers(fx.listing_pages(spark, sf_dir), mode="pattern")


@query("drop_blob_logs", sql=f"""SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents
  WHERE NOT (length(text) > {rules.BLOB_LOG_MIN_CHARS} AND (contains(text, '/') OR contains(text, '+')))""")
def drop_blob_logs(spark, sf_dir):
    """Log lines longer than 1000 chars holding '/' or '+' (encoded blobs) are dropped."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    return X.drop_blob_logs(d, "text").select("doc_id", F.length("text").cast("long").alias("n_chars"))


_CUT_OFF_SQL = f"regexp_matches(html, {_re(X.CUT_OFF)})"


@query("quarantine", sql=f"""SELECT page_id, CASE WHEN html IS NULL OR length(html) = 0 THEN 'empty' WHEN {_CUT_OFF_SQL} THEN 'cut off inside a tag'
    WHEN length({main_text_sql('html')}) < 1 THEN 'no_text' ELSE 'ok' END AS status FROM (
    SELECT page_id, html FROM pages UNION ALL SELECT -page_id - 1, substr(html, 1, strpos(html, '<img src=') + 5) FROM listing_pages) p""",
       fixtures=["listing_pages"])
def quarantine(spark, sf_dir):
    """Each page is either processed ('ok') or set aside with a reason; one bad page never stops the
    rest. Raw pages, and listing pages as a broken download leaves them: cut off inside a tag. Both kinds are
    written in one pass and read back from where they went."""
    cut = F.expr("substr(html, 1, instr(html, '<img src=') + 5)")
    p = load(spark, sf_dir, "pages").select("page_id", "html").unionByName(
        fx.listing_pages(spark, sf_dir).select((-F.col("page_id") - 1).alias("page_id"), cut.alias("html")))
    good, bad, _counts = X.split_errors(X.page_status(p))
    return good.unionByName(bad).select("page_id", "status")


def _chunk_offers_sql() -> str:
    from ..functions.relevance import STOP_CTE, score_sql, terms_select
    from . import sql_rules as SR
    from .extract_queries import _HOST_SQL
    fold, fin = _chunks_sql("ls", "generic")
    pages = (f"SELECT page_id, url, regexp_extract(first_text, '^(?:Popular |New )?(\\S+ \\S+)', 1) AS query, "
             f"{main_text_sql('html')} AS text, {_LINKS_SQL} AS links, {_IMGS_SQL} AS images FROM listing_pages")
    chunks = f"""SELECT page_id, url, query, links, images, CAST(k - 1 AS INTEGER) AS pos,
        array_to_string(ls[c.s + 1:c.e], {_NL}) AS chunk FROM (
      SELECT *, unnest(bnd) AS c, generate_subscripts(bnd, 1) AS k FROM (
        SELECT *, {fin} AS bnd FROM (SELECT *, {fold} AS f FROM (
          SELECT *, {_lines_sql('text')} AS ls FROM ({pages}) p WHERE length(text) >= 1) a) b) c) d"""
    rel = f"SELECT *, {score_sql('tq', 'tc')} AS rel FROM ({terms_select(chunks, {'tq': 'query', 'tc': 'chunk'})}) r"
    eo = SR.entity_offer("chunk")
    offers = (f"SELECT *, {eo['title']} AS o_title, {eo['price']} AS o_price, {eo['currency']} AS o_currency, "
              f"{eo['description']} AS o_desc FROM ({rel}) e WHERE rel >= {rules.RELEVANCE_MIN}")
    host = _HOST_SQL
    src = "CASE " + " ".join(f"WHEN contains({host}, '{h}') THEN '{n}'" for h, n, _k in rules.HOST_SOURCES) + " ELSE 'Unknown' END"
    key = "CASE " + " ".join(f"WHEN contains({host}, '{h}') THEN '{k}'" for h, _n, k in rules.HOST_SOURCES) + " ELSE 'unknown' END"
    return f"""WITH {STOP_CTE}
  SELECT {key} || '_' || substr(sha256(o_title || CAST(pos AS VARCHAR)), 1, 16) AS id, page_id, pos,
         o_title AS title, o_price AS price, o_currency AS currency, o_desc AS description,
         coalesce(links[pos + 1], url) AS url, coalesce(images[pos + 1], '') AS image_url,
         {src} AS source, {key} AS source_key, rel
  FROM ({offers}) o WHERE length(o_title) > 5 AND o_price > 0"""


@query("chunk_offers", sql=_chunk_offers_sql(), fixtures=["listing_pages"])
def chunk_offers(spark, sf_dir):
    """Generic chunk -> offer job over listing pages; each page is searched for
    the product name of its first listing."""
    p = fx.listing_pages(spark, sf_dir)
    q = F.regexp_extract(F.col("first_text"), r"^(?:Popular |New )?(\S+ \S+)", 1)
    return X.chunk_offers(p.withColumn("query", q))



