"""Search -> comparison table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import compare as C
from ..sources import fixtures as fx
from .registry import query

QUOTA = C.site_quota()            # 4 offers per site
TOP = rules.RESULTS_PER_SEARCH    # 20 per search
L = fx.LINE_ORDER_SQL
ORDER = ("site_ord", *fx.LINE_ORDER)  # stable order of a search's offers: sites, then page order


def union_sites_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cap_per_site(fx.offers(spark, sf_dir), QUOTA, order=fx.LINE_ORDER)


def cheapest_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cheapest(fx.offers(spark, sf_dir), TOP, tie=ORDER)


def filtered_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.apply_filters(fx.offers(spark, sf_dir), fx.searches(spark, sf_dir))


UNION_SQL = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, site_ord ORDER BY {L}) - 1 AS pos
               FROM offers) u WHERE pos < {QUOTA}"""
CHEAPEST_SQL = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
                    ORDER BY coalesce(price, 0.0), site_ord, {L}) AS rank FROM offers) c WHERE rank <= {TOP}"""
FILTER_WHERE = """(s.min_price IS NULL OR c.price >= s.min_price)
  AND (s.max_price IS NULL OR c.price <= s.max_price)
  AND (coalesce(len(s.retailers), 0) = 0 OR list_contains(s.retailers, c.{by}))
  AND (s.category IS NULL OR s.category NOT IN (SELECT category FROM cat_kw)
       OR EXISTS (SELECT 1 FROM cat_kw k WHERE k.category = s.category AND contains(lower(c.title), k.keyword)))"""
FILTERED_SQL = f"""SELECT c.* FROM offers c LEFT JOIN searches s USING (query_id)
WHERE {FILTER_WHERE.format(by='site_key')}"""
FX = ["offers", "searches", "cat_kw"]
ROW = ["query_id", "site_key", *fx.LINE_ORDER[:2]]  # what names an offer in a result
ROWS = ", ".join(ROW)


@query("union_sites", sql=f"SELECT query_id, site_key, pos, title, price FROM ({UNION_SQL}) x", fixtures=FX)
def union_sites(spark, sf_dir):
    """Each site's first offers (quota per site), all sites in one table."""
    return union_sites_df(spark, sf_dir).select("query_id", "site_key", "pos", "title", "price")


@query("cheapest_offers", sql=f"SELECT query_id, rank, site_key, title, price FROM ({CHEAPEST_SQL}) x",
       fixtures=FX)
def cheapest_offers(spark, sf_dir):
    """Per search, the union sorted by price (stable), first 20."""
    return cheapest_df(spark, sf_dir).select("query_id", "rank", "site_key", "title", "price")


@query("filter_offers", sql=f"SELECT {ROWS}, title, price FROM ({FILTERED_SQL}) x", fixtures=FX)
def filter_offers(spark, sf_dir):
    """min/max price, retailer list and category filters over all offers."""
    return filtered_df(spark, sf_dir).select(*ROW, "title", "price")


@query("best_deal", sql=f"""SELECT {ROWS}, title, price,
  row_number() OVER (PARTITION BY query_id ORDER BY coalesce(price, 0.0), site_ord, {L}) = 1 AS best_deal
  FROM ({FILTERED_SQL}) x""", fixtures=FX)
def best_deal(spark, sf_dir):
    """The cheapest row of each filtered result list is the best deal."""
    return C.flag_first(filtered_df(spark, sf_dir), [F.coalesce("price", F.lit(0.0)), *ORDER]).select(
        *ROW, "title", "price", "best_deal")


@query("lowest_positive", sql=f"""SELECT {ROWS}, title, price,
  (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN price > 0 THEN price END ASC NULLS LAST, site_ord, {L}) = 1
   AND coalesce(price, 0) > 0) AS is_lowest FROM ({FILTERED_SQL}) x""", fixtures=FX)
def lowest_positive(spark, sf_dir):
    """Highlight the lowest positive price of each result list (first on a tie)."""
    return C.flag_lowest_positive(filtered_df(spark, sf_dir), list(ORDER)).select(*ROW, "title", "price", "is_lowest")


@query("sort_price_asc", sql=f"""SELECT {ROWS}, price,
  row_number() OVER (PARTITION BY query_id ORDER BY coalesce(price, 0.0) ASC, site_ord, {L}) AS sort_pos
  FROM ({FILTERED_SQL}) x""", fixtures=FX)
def sort_price_asc(spark, sf_dir):
    """C4: every result list sorted by price, ascending."""
    return C.sort_offers(filtered_df(spark, sf_dir), True, tie=ORDER).select(*ROW, "price", "sort_pos")


@query("sort_price_desc", sql=f"""SELECT {ROWS}, price,
  row_number() OVER (PARTITION BY query_id ORDER BY coalesce(price, 0.0) DESC, site_ord, {L}) AS sort_pos
  FROM ({FILTERED_SQL}) x""", fixtures=FX)
def sort_price_desc(spark, sf_dir):
    """C4: every result list sorted by price, descending."""
    return C.sort_offers(filtered_df(spark, sf_dir), False, tie=ORDER).select(*ROW, "price", "sort_pos")


_NAME_MAP_SQL = "CASE r " + " ".join(f"WHEN '{k}' THEN '{n}'" for (_o, k, n, *_x) in rules.SITES) + " ELSE r END"


@query("filter_count", sql=f"""SELECT c.query_id, count(*) AS visible FROM offers c
  LEFT JOIN (SELECT query_id, category, min_price, max_price,
                    list_transform(retailers, lambda r: {_NAME_MAP_SQL}) AS retailers FROM searches) s USING (query_id)
  WHERE {FILTER_WHERE.format(by='source').replace('c.price', 'coalesce(c.price, 0.0)')}
  GROUP BY c.query_id""", fixtures=FX)
def filter_count(spark, sf_dir):
    """Result-page filter (retailers by display name, missing price = 0) and visible count."""
    names = F.create_map(*[x for (_o, k, n, *_r) in rules.SITES for x in (F.lit(k), F.lit(n))])
    s = fx.searches(spark, sf_dir).withColumn(
        "retailers", F.transform("retailers", lambda r: F.coalesce(F.try_element_at(names, r), r)))
    f = C.apply_filters(fx.offers(spark, sf_dir), s, by="source", missing_price_as_zero=True)
    return f.groupBy("query_id").agg(F.count(F.lit(1)).alias("visible"))


@query("single_site", sql=f"SELECT {ROWS}, title, price FROM offers WHERE site_key = 'jumia'", fixtures=FX)
def single_site(spark, sf_dir):
    """One site's offers only, all of them."""
    return C.offers_for_site(fx.offers(spark, sf_dir), "jumia").select(*ROW, "title", "price")


@query("offer_counts", sql="""SELECT coalesce(query_id, -1) AS query_id, coalesce(site_key, 'all') AS site_key,
  CAST(grouping(query_id, site_key) AS BIGINT) AS level, count(*) AS n_offers FROM offers
  GROUP BY ROLLUP (query_id, site_key)""", fixtures=FX)
def offer_counts(spark, sf_dir):
    """Offers per search and site, with subtotals."""
    return C.offer_counts(fx.offers(spark, sf_dir))


@query("search_urls", sql="""SELECT query_id, t.site_ord, t.site_key,
  t.search_prefix || replace(url_encode(query), '%20', '+') AS search_url
  FROM searches, sites t""", fixtures=["searches", "sites"])
def search_urls(spark, sf_dir):
    """One search URL per (search, site)."""
    return C.search_urls(fx.searches(spark, sf_dir))


@query("site_quota", sql=f"""SELECT query_id, (SELECT count(*) FROM sites) AS n_sites,
  CAST(greatest(1, {TOP} // (SELECT count(*) FROM sites)) AS BIGINT) AS quota FROM searches""", fixtures=["searches", "sites"])
def site_quota(spark, sf_dir):
    """Sites searched and the per-site share of the result list."""
    return C.with_site_quota(fx.searches(spark, sf_dir), fx.sites(spark))
