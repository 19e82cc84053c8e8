"""Comparison tables: per-site caps, cheapest-N, filters, flags, counts.

All operators work on a table of many searches at once (keyed by ``query_id``).
Top-N per key is written as ``row_number() <= N`` over a window so the planner
inserts a partial (map-side) WindowGroupLimit before the shuffle: a search that
owns a third of all offers still ships only N rows per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from .windows import skew_safe_row_number

DEFAULT_TIE = ("site_ord", "pos")


def _order(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def site_quota(total: int = rules.RESULTS_PER_SEARCH, n_sites: int = len(rules.SITES)) -> int:
    """Offers taken from each site: ``max(1, total // n_sites)``."""
    return max(1, total // n_sites)


def cap_per_site(offers: DataFrame, n: int, order: Sequence[str | Column],
                 key: str = "query_id", site: str = "site_ord") -> DataFrame:
    """First ``n`` offers of each (search, site) in page order; adds 0-based ``pos``."""
    w = Window.partitionBy(key, site).orderBy(*_order(order))
    return (offers.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= n)
            .withColumn("pos", (F.col("_rn") - 1).cast("long")).drop("_rn"))


def cheapest(offers: DataFrame, n: int = rules.RESULTS_PER_SEARCH, key: str = "query_id",
             tie: Sequence[str] = DEFAULT_TIE) -> DataFrame:
    """Price ascending (missing price counts as 0), stable, first ``n`` per search; adds ``rank``."""
    w = Window.partitionBy(key).orderBy(F.coalesce(F.col("price"), F.lit(0.0)), *_order(tie))
    return (offers.withColumn("rank", F.row_number().over(w).cast("long"))
            .filter(F.col("rank") <= n))


def category_keywords() -> Column:
    """The category dictionary as a literal ``MAP<STRING, ARRAY<STRING>>``."""
    kv = []
    for cat, words in rules.CATEGORY_KEYWORDS.items():
        kv += [F.lit(cat), F.array(*[F.lit(w) for w in words])]
    return F.create_map(*kv)


def filter_predicate(price: Column, site_key: Column, title: Column, category: Column,
                     min_price: Column, max_price: Column, retailers: Column) -> Column:
    """The result filters; a NULL / empty setting switches that filter off."""
    kw = F.try_element_at(category_keywords(), category)
    low = F.lower(title)
    return ((min_price.isNull() | (price >= min_price))
            & (max_price.isNull() | (price <= max_price))
            & ((F.coalesce(F.size(retailers), F.lit(0)) == 0) | F.array_contains(retailers, site_key))
            & (kw.isNull() | F.exists(kw, lambda k: F.contains(low, k))))


def apply_filters(offers: DataFrame, searches: DataFrame, key: str = "query_id",
                  by: str = "site_key", missing_price_as_zero: bool = False) -> DataFrame:
    """Keep offers passing their search's min/max price, retailer list and category.

    ``by='source'`` compares retailers by display name and counts a missing price
    as 0 (the result-page variant).
    """
    s = searches.select(key, "category", "min_price", "max_price", "retailers")
    j = offers.join(s, key, "left")
    price = F.coalesce(F.col("price"), F.lit(0.0)) if missing_price_as_zero else F.col("price")
    pred = filter_predicate(price, F.col(by), F.col("title"), F.col("category"),
                            F.col("min_price"), F.col("max_price"), F.col("retailers"))
    return j.filter(pred).drop("category", "min_price", "max_price", "retailers")


def _flag_min(df: DataFrame, rank: Sequence[Column], key: str, name: str, ok: Column) -> DataFrame:
    """Flag the row of each key with the least ``rank``, if ``ok``.

    The least rank per key is an aggregate with map-side combine; its join back is one row per
    key against all rows, which AQE splits where a key is hot. (A window would sort a whole
    key in one task.) ``rank`` must tell rows apart; of equal rows the first id is flagged.
    """
    r = df.withColumn("_rank", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(rank)]))
    least = r.groupBy(key).agg(F.min("_rank").alias("_least")).withColumnRenamed(key, "_key")
    j = r.join(least, F.col(key).eqNullSafe(F.col("_key")))
    return j.withColumn(name, (F.col("_rank") == F.col("_least")) & ok).drop("_rank", "_least", "_key")


def flag_first(df: DataFrame, order: Sequence[str | Column], key: str = "query_id",
               name: str = "best_deal") -> DataFrame:
    """Flag the first row of each result list."""
    return _flag_min(df, _order(order), key, name, F.lit(True))


def flag_lowest_positive(df: DataFrame, order: Sequence[str | Column], key: str = "query_id",
                         name: str = "is_lowest") -> DataFrame:
    """Flag the row with the lowest positive price (first on a tie); none if no positive price."""
    positive = F.coalesce(F.col("price") > 0, F.lit(False))
    rank = [~positive, F.when(positive, F.col("price")), *_order(order)]
    return _flag_min(df, rank, key, name, positive)


def sort_offers(df: DataFrame, ascending: bool = True, key: str = "query_id",
                tie: Sequence[str] = ("rank",), name: str = "sort_pos") -> DataFrame:
    """Number each result list by price (missing = 0), stable on ``tie``; a list of any length
    is numbered by many tasks."""
    p = F.coalesce(F.col("price"), F.lit(0.0))
    numbered = skew_safe_row_number(df.withColumn("_by", p if ascending else -p), key, ["_by", *tie], name, lead=1)
    return numbered.drop("_by")


def offers_for_site(df: DataFrame, site_key: str) -> DataFrame:
    """Offers of one site; an unknown key gives an empty table."""
    return df.filter(F.col("site_key") == F.lit(site_key))


def offer_counts(df: DataFrame, key: str = "query_id", site: str = "site_key") -> DataFrame:
    """Offer counts per search and site, with per-search and grand totals.

    ``level`` is the grouping id (0 = search and site, 1 = search, 3 = all); rolled-up
    keys read -1 / 'all' so key columns stay non-null.
    """
    return (df.rollup(key, site)
            .agg(F.count(F.lit(1)).alias("n_offers"), F.grouping_id().alias("level"))
            .select(F.coalesce(F.col(key), F.lit(-1)).alias(key),
                    F.coalesce(F.col(site), F.lit("all")).alias(site),
                    F.col("level").cast("long").alias("level"), "n_offers"))


def sites_array() -> Column:
    return F.array(*[F.struct(F.lit(o).alias("site_ord"), F.lit(k).alias("site_key"),
                              F.lit(n).alias("source"), F.lit(p).alias("search_prefix"))
                     for (o, k, n, p, _r, _h) in rules.SITES])


def quote_plus(col: Column) -> Column:
    """Form-encoding of a query (space -> '+'); Java's encoder differs on '~' and '*'."""
    return F.replace(F.replace(F.url_encode(col), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def search_urls(searches: DataFrame, key: str = "query_id") -> DataFrame:
    """One search URL per (search, site): site prefix + encoded query.

    The five sites are a constant array exploded per row (a Generate inside the
    same stage), not a join.
    """
    s = searches.select(key, "query", F.explode(sites_array()).alias("s"))
    return s.select(key, "s.site_ord", "s.site_key",
                    F.concat(F.col("s.search_prefix"), quote_plus(F.col("query"))).alias("search_url"))


def with_site_quota(searches: DataFrame, sites: DataFrame, total: int = rules.RESULTS_PER_SEARCH,
                    key: str = "query_id") -> DataFrame:
    """Per search: available sites and the per-site quota ``max(1, total // n_sites)``; the sites are
    counted from their table (a scalar subquery)."""
    n = sites.select(F.count(F.lit(1))).scalar()
    return searches.select(key, n.cast("long").alias("n_sites"),
                           F.greatest(F.lit(1), F.floor(F.lit(total) / n)).cast("long").alias("quota"))
