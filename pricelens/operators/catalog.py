"""Product / source / price catalogue: comparison views and set-based upserts.

Upserts are "latest version per natural key" aggregations over the union of
the current table and the batch. They are written as ``groupBy(key).agg(max_by)``
(hash aggregation with map-side partial aggregation), so a key with many
versions never lands whole in one task the way a window sort would. A job that
persists the result stages it and replaces only the affected partitions (see
``streaming.refresh``); nothing overwrites a path it is reading.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from .windows import skew_safe_row_number

SOURCE_SCHEMA = T.StructType([
    T.StructField("source_id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("logo", T.StringType(), True),
    T.StructField("active", T.BooleanType(), True),
])


def seed_sources(spark) -> DataFrame:
    """The seven default sources."""
    from ..sources.fixtures import literal_rows
    return literal_rows(spark, rules.SEED_SOURCES, SOURCE_SCHEMA)


def init_sources(current: DataFrame, spark) -> DataFrame:
    """Seed the default sources only when the source table is empty.

    The emptiness test is an EXISTS subquery planned with the job, not a
    driver-side count.
    """
    seeds = seed_sources(spark).select(*current.columns)
    return current.unionByName(seeds.filter(~current.exists()))


def _latest(df: DataFrame, keys: Sequence[str], order: Column, cols: Sequence[str]) -> DataFrame:
    """Per key, the row with the greatest ``order`` (a struct); map-side partial aggregation."""
    packed = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(*keys).agg(F.max_by(packed, order).alias("_r"))
            .select(*keys, *[F.col("_r")[c].alias(c) for c in cols]))


def _first(df: DataFrame, keys: Sequence[str], order: Column, cols: Sequence[str]) -> DataFrame:
    packed = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(*keys).agg(F.min_by(packed, order).alias("_r"))
            .select(*keys, *[F.col("_r")[c].alias(c) for c in cols]))


def upsert_products(current: DataFrame, batch: DataFrame, order: Sequence[str],
                    key: str = "product_id") -> DataFrame:
    """Insert products whose id is absent; never update; inside the batch the first row wins."""
    cols = [c for c in current.columns if c != key]
    first = _first(batch, [key], F.struct(*[F.col(c) for c in order]), cols)
    new = first.join(current.select(key), key, "left_anti")
    return current.unionByName(new.select(*current.columns))


def upsert_sources(current: DataFrame, batch_names: DataFrame, order: Sequence[str]) -> DataFrame:
    """Get-or-create sources by exact name. New names get ids after the current
    maximum, numbered in order of first appearance; logo = site key, url = ''.

    ``batch_names`` has ``name``, ``site_key`` and the ``order`` columns. New names
    are numbered slice by slice (no single task sorts them all).
    """
    first = _first(batch_names, ["name"], F.struct(*[F.col(c) for c in order]),
                   ["site_key", *order])
    new = first.join(current.select("name"), "name", "left_anti")
    base = current.select(F.coalesce(F.max("source_id"), F.lit(0))).scalar()  # scalar subquery
    numbered = (skew_safe_row_number(new.withColumn("_all", F.lit(0)), "_all", list(order), "_no")
                .select((base + F.col("_no")).cast("long").alias("source_id"), "name",
                        F.lit("").alias("url"), F.col("site_key").alias("logo"), F.lit(True).alias("active")))
    return current.unionByName(numbered.select(*current.columns))


def upsert_prices(current: DataFrame, batch: DataFrame, batch_order: Sequence[str],
                  keys: Sequence[str] = ("product_id", "source_id"),
                  cols: Sequence[str] = ("price", "url", "last_updated")) -> DataFrame:
    """Update price/url/last_updated of existing (product, source) entries, insert
    the others; inside the batch the last row wins."""
    cur = current.select(*keys, *cols, F.lit(0).alias("_b"),
                         *[F.lit(None).cast(batch.schema[c].dataType).alias("_o_" + c) for c in batch_order])
    new = batch.select(*keys, *cols, F.lit(1).alias("_b"), *[F.col(c).alias("_o_" + c) for c in batch_order])
    order = F.struct(F.col("_b"), *[F.col("_o_" + c) for c in batch_order])
    return _latest(cur.unionByName(new), list(keys), order, list(cols))


def refresh_prices(current: DataFrame, sources: DataFrame, offers: DataFrame,
                   product_ids: DataFrame, batch_order: Sequence[str]) -> DataFrame:
    """Re-price requested products only: offers whose id is requested and whose
    source name exists (unknown sources are skipped), then upsert."""
    b = (offers.join(product_ids, "product_id", "left_semi")
         .join(sources.select(F.col("name").alias("source"), "source_id"), "source", "inner"))
    return upsert_prices(current, b, batch_order)


def price_comparison(products: DataFrame, entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Each product's entries with source name, sorted by price, best flagged,
    printed price and check time.

    The per-product numbering runs on the narrow entries (skew-safe: a product
    with a huge number of entries is spread over many tasks); names are joined
    afterwards, sources first and products last so the product join reuses one
    product_id partitioning whatever strategy the (smaller) source join gets.
    """
    ranked = skew_safe_row_number(entries.select("product_id", "source_id", "price", "last_updated"),
                                  "product_id", ["price", "source_id"], "price_rank", lead=1)
    j = (ranked.join(sources.select("source_id", F.col("name").alias("source_name")), "source_id")
         .join(products.select("product_id", F.col("name").alias("product_name")), "product_id"))
    return j.select(
        "product_id", "product_name", "source_name", "price", "price_rank",
        F.format_string("$%.2f", F.col("price")).alias("price_text"),
        F.date_format("last_updated", "yyyy-MM-dd HH:mm").alias("checked_at"),
    ).withColumn("is_best", F.col("price_rank") == 1)


def best_price(entries: DataFrame) -> DataFrame:
    """Per product, the entry with the lowest price (first by source id on a tie)."""
    return _first(entries, ["product_id"], F.struct("price", "source_id"),
                  ["source_id", "price", "url"])


def last_checked(entries: DataFrame) -> DataFrame:
    """'Prices last checked' = time of the cheapest entry, not the newest."""
    return entries.groupBy("product_id").agg(
        F.min_by("last_updated", F.struct("price", "source_id")).alias("last_checked"))
