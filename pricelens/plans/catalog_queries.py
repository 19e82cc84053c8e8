"""Catalogue queries: comparison page, best price, seeding and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import catalog as K
from ..sources import fixtures as fx
from ..sources.tables import load
from .registry import query

L = fx.LINE_ORDER
LD = ", ".join(f"{c} DESC" for c in L)
SPLIT = "2000-01-01 00:00:00"  # catalogue state before this time; the rest is the update batch
PE_COLS = ["price", "url", "last_updated"]


def price_entries(spark, sf_dir, before: str | None = None):
    """Current price entries: latest observation per (product, source)."""
    feed = fx.price_feed(spark, sf_dir)
    if before:
        feed = feed.filter(F.col("last_updated") < F.lit(before).cast("timestamp"))
    return K._latest(feed, ["product_id", "source_id"], F.struct("last_updated", *L), PE_COLS)


def _pe_sql(where: str = "TRUE") -> str:
    return f"""SELECT product_id, source_id, price, url, last_updated FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id, source_id ORDER BY last_updated DESC, {LD}) AS rn
  FROM price_feed WHERE {where}) t WHERE rn = 1"""


PE_SQL = _pe_sql()
FXC = ["price_feed", "products", "catalog_sources"]


@query("price_comparison", sql=f"""SELECT pe.product_id, p.name AS product_name, s.name AS source_name, pe.price,
  row_number() OVER (PARTITION BY pe.product_id ORDER BY pe.price, pe.source_id) AS price_rank,
  printf('$%.2f', pe.price) AS price_text, strftime(pe.last_updated, '%Y-%m-%d %H:%M') AS checked_at,
  row_number() OVER (PARTITION BY pe.product_id ORDER BY pe.price, pe.source_id) = 1 AS is_best
  FROM ({PE_SQL}) pe JOIN products p USING (product_id) JOIN catalog_sources s USING (source_id)""", fixtures=FXC)
def price_comparison(spark, sf_dir):
    """Product x price entries x sources, by price, best flagged."""
    # the latest price and time only: product, source and url are not carried along with each observation
    own = [c for c in L if c not in ("l_partkey", "l_suppkey")]
    latest = fx.price_feed(spark, sf_dir).groupBy("product_id", "source_id").agg(F.max(F.struct("last_updated", *own)).alias("r"))
    entries = latest.select("product_id", "source_id", F.col("r.l_extendedprice").alias("price"), "r.last_updated")
    return K.price_comparison(fx.products(spark, sf_dir), entries,
                              fx.catalog_sources(spark, sf_dir))


_BEST_SQL = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, source_id) AS rn
  FROM ({PE_SQL}) pe) b WHERE rn = 1"""


@query("best_price", sql=f"SELECT product_id, source_id, price, url FROM ({_BEST_SQL}) x", fixtures=FXC)
def best_price(spark, sf_dir):
    """The lowest-priced entry of each product."""
    return K.best_price(price_entries(spark, sf_dir))


@query("last_checked", sql=f"SELECT product_id, last_updated AS last_checked FROM ({_BEST_SQL}) x", fixtures=FXC)
def last_checked(spark, sf_dir):
    """Check time shown on the comparison page (that of the cheapest entry)."""
    return K.last_checked(price_entries(spark, sf_dir))


_SEED_SQL = fx._values_sql(rules.SEED_SOURCES, ["source_id", "name", "url", "logo", "active"])


_SOURCE_TABLES = {"all": "TRUE", "without offers": "source_id NOT IN (SELECT source_id FROM price_feed)"}


@query("seed_sources", sql=" UNION ALL ".join(f"""
  SELECT '{n}' AS catalogue, source_id, name, url, CAST(NULL AS VARCHAR) AS logo, TRUE AS active FROM catalog_sources WHERE {w}
  UNION ALL SELECT '{n}', s.* FROM ({_SEED_SQL}) s WHERE NOT EXISTS (SELECT 1 FROM catalog_sources WHERE {w})""" for n, w in _SOURCE_TABLES.items()), fixtures=FXC)
def seed_sources(spark, sf_dir):
    """A source table, seeded with the defaults only if it was empty: all sources, and those
    that no offer names (none as long as every supplier delivers, so this table is seeded)."""
    cur = fx.catalog_sources(spark, sf_dir).select(
        "source_id", "name", "url", F.lit(None).cast("string").alias("logo"), F.lit(True).alias("active"))
    idle = cur.join(fx.price_feed(spark, sf_dir).select("source_id").distinct(), "source_id", "left_anti")
    return K.init_sources(cur, spark).withColumn("catalogue", F.lit("all")).unionByName(
        K.init_sources(idle, spark).withColumn("catalogue", F.lit("without offers")))


def _batch_products(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(*L)
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").cast("string").alias("product_id"),
        fx.offer_title(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("name"),
        F.concat(F.lit("https://img.example.com/product/"), F.col("l_partkey").cast("string"), F.lit("/"),
                 F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("image_url"), *L)


@query("upsert_products", sql=f"""SELECT product_id, name, image_url FROM products WHERE CAST(product_id AS BIGINT) % 3 <> 0
  UNION ALL
  SELECT product_id, name, image_url FROM (
    SELECT CAST(l_partkey AS VARCHAR) AS product_id, concat_ws(' ', p_name, replace(p_brand, '#', ' '), p_type) AS name,
      'https://img.example.com/product/' || CAST(l_partkey AS VARCHAR) || '/' || CAST(l_orderkey AS VARCHAR) || '.jpg' AS image_url,
      row_number() OVER (PARTITION BY l_partkey ORDER BY {fx.LINE_ORDER_SQL}) AS rn
    FROM lineitem JOIN part ON p_partkey = l_partkey) b
  WHERE rn = 1 AND product_id NOT IN (SELECT product_id FROM products WHERE CAST(product_id AS BIGINT) % 3 <> 0)""",
       fixtures=FXC)
def upsert_products(spark, sf_dir):
    """Add products whose id is new (first batch row wins); existing ones stay unchanged."""
    cur = fx.products(spark, sf_dir).filter(F.col("product_id").cast("long") % 3 != 0)
    return K.upsert_products(cur, _batch_products(spark, sf_dir), order=L)


@query("upsert_sources", sql=f"""WITH seed AS ({_SEED_SQL}),
  new AS (SELECT name, site_key, q, r FROM (
    SELECT source AS name, site_key, query_id AS q, site_ord AS r,
           row_number() OVER (PARTITION BY source ORDER BY query_id, site_ord, {fx.LINE_ORDER_SQL}) AS rn FROM offers) t
    WHERE rn = 1 AND name NOT IN (SELECT name FROM seed))
  SELECT * FROM seed UNION ALL
  SELECT CAST((SELECT max(source_id) FROM seed) + row_number() OVER (ORDER BY q, r) AS BIGINT), name, '', site_key, TRUE
  FROM new""", fixtures=["offers", "searches"])
def upsert_sources(spark, sf_dir):
    """Get-or-create the offers' sources by exact name (site names differ from seed names)."""
    batch = fx.offers(spark, sf_dir).select(F.col("source").alias("name"), "site_key",
                                            F.col("query_id").alias("q"), F.col("site_ord").alias("r"))
    return K.upsert_sources(K.seed_sources(spark), batch, order=["q", "r"])


@query("upsert_prices", sql=f"""SELECT product_id, source_id, price, url, last_updated FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id, source_id ORDER BY b DESC, last_updated DESC, {LD}) AS rn
  FROM (SELECT product_id, source_id, price, url, last_updated, 0 AS b,
               NULL::BIGINT AS l_orderkey, NULL::INT AS l_linenumber, NULL::BIGINT AS l_partkey,
               NULL::BIGINT AS l_suppkey, NULL::DOUBLE AS l_extendedprice, NULL::DOUBLE AS l_quantity
        FROM ({_pe_sql(f"last_updated < TIMESTAMP '{SPLIT}'")}) cur
        UNION ALL
        SELECT product_id, source_id, price, url, last_updated, 1 AS b, {fx.LINE_ORDER_SQL}
        FROM price_feed WHERE last_updated >= TIMESTAMP '{SPLIT}') u) t WHERE rn = 1""", fixtures=FXC)
def upsert_prices(spark, sf_dir):
    """Update-or-insert price entries by (product, source); last batch row wins."""
    cur = price_entries(spark, sf_dir, before=SPLIT)
    batch = fx.price_feed(spark, sf_dir).filter(F.col("last_updated") >= F.lit(SPLIT).cast("timestamp"))
    return K.upsert_prices(cur, batch, ["last_updated", *L])


@query("refresh_prices", sql=f"""WITH src AS (SELECT * FROM catalog_sources WHERE source_id % 10 <> 3),
  cur AS ({_pe_sql(f"last_updated < TIMESTAMP '{SPLIT}'")}),
  b AS (SELECT f.product_id, s.source_id, f.price, f.url, f.last_updated, {', '.join('f.' + c for c in L)}
        FROM price_feed f JOIN supplier ON s_suppkey = f.source_id JOIN src s ON s.name = s_name
        WHERE f.last_updated >= TIMESTAMP '{SPLIT}' AND f.product_id IN (SELECT product_id FROM products))
  SELECT product_id, source_id, price, url, last_updated FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id, source_id ORDER BY bb DESC, last_updated DESC, {LD}) AS rn
    FROM (SELECT product_id, source_id, price, url, last_updated, 0 AS bb,
                 NULL::BIGINT AS l_orderkey, NULL::INT AS l_linenumber, NULL::BIGINT AS l_partkey,
                 NULL::BIGINT AS l_suppkey, NULL::DOUBLE AS l_extendedprice, NULL::DOUBLE AS l_quantity FROM cur
          UNION ALL SELECT product_id, source_id, price, url, last_updated, 1 AS bb, {fx.LINE_ORDER_SQL} FROM b) u
  ) t WHERE rn = 1""", fixtures=FXC)
def refresh_prices(spark, sf_dir):
    """U4: re-price requested products from fresh offers; offers of unknown sources are skipped."""
    cur = price_entries(spark, sf_dir, before=SPLIT)
    sources = fx.catalog_sources(spark, sf_dir).filter(F.col("source_id") % 10 != 3)
    sup = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source"))
    offers = (fx.price_feed(spark, sf_dir).filter(F.col("last_updated") >= F.lit(SPLIT).cast("timestamp"))
              .join(sup, "source_id").drop("source_id"))
    ids = fx.products(spark, sf_dir).select("product_id")
    return K.refresh_prices(cur, sources, offers, ids, ["last_updated", *L])


@query("seed_products", sql="""SELECT concat_ws(' ', p_name, replace(p_brand, '#', ' '), p_type) AS title,
  p_retailprice AS price, lower(p_type) AS category,
  'https://img.example.com/product/' || CAST(p_partkey AS VARCHAR) || '.jpg' AS image_url,
  'https://shop.example.com/item/' || CAST(p_partkey AS VARCHAR) AS product_url FROM part""")
def seed_products(spark, sf_dir):
    """Seed products written as JSON arrays (at most 100 products per array, one
    array per line) and scanned back with the explicit seed schema."""
    from ..session import scratch_path
    from ..sources import readers
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    prod = F.struct(fx.offer_title(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("title"),
                    F.col("p_retailprice").alias("price"), F.lower("p_type").alias("category"),
                    F.concat(F.lit("https://img.example.com/product/"), F.col("p_partkey").cast("string"),
                             F.lit(".jpg")).alias("image_url"),
                    F.concat(F.lit("https://shop.example.com/item/"), F.col("p_partkey").cast("string")).alias("product_url"))
    arrays = p.groupBy(F.floor(F.col("p_partkey") / 100).alias("grp")).agg(F.to_json(F.collect_list(prod)).alias("value"))
    path = scratch_path(spark, "seed-products")
    arrays.select("value").write.text(path)
    return readers.read_seed_products(spark, path, multiline=False)
