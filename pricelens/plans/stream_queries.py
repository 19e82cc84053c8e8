"""Streaming queries (M1, M2): each replays table-derived files through a
Structured Streaming job (availableNow trigger) and returns its final output."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..sources import fixtures as fx
from ..sources.tables import load
from ..streaming import refresh as M1
from ..streaming import reuse as M2
from .catalog_queries import SPLIT
from .registry import query

L = fx.LINE_ORDER
LD = ", ".join(f"{c} DESC" for c in L)
ORDER_DAYS = 10_000  # how far apart the requests of one trigger may lie

# Same rows as upsert_prices: the stream applies the post-split feed to the pre-split state.
_STREAM_REFRESH_SQL = f"""SELECT product_id, source_id, price, url, last_updated FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id, source_id ORDER BY last_updated DESC, {LD}) AS rn
  FROM price_feed) t WHERE rn = 1"""


@query("stream_refresh", sql=_STREAM_REFRESH_SQL, fixtures=["price_feed"])
def stream_refresh(spark, sf_dir):
    """M1: price observations after the split time arrive as a file stream (a few
    files per trigger) and are upserted into a key-clustered catalogue; each
    batch rewrites only the files that hold its keys, or is put beside them if those are most of
    the files. Of the feed's tie-break columns only those are carried that are neither key nor price."""
    feed = fx.price_feed(spark, sf_dir)
    split = F.lit(SPLIT).cast("timestamp")
    keys, cols = ["product_id", "source_id"], ["price", "url", "last_updated"]
    order = ["last_updated", *[{"l_extendedprice": "price"}.get(c, c) for c in L if c not in ("l_partkey", "l_suppkey")]]
    feed = feed.select(*keys, *dict.fromkeys([*cols, *order]))
    base = M1.staging_path(spark, "refresh")
    src, ckpt = os.path.join(base, "feed"), os.path.join(base, "_checkpoint")
    catalogue = M1.Catalogue(spark, os.path.join(base, "catalog"), keys)
    before = feed.filter(F.col("last_updated") < split)
    catalogue.load(M1.newest(before, keys, order, cols), before.count())
    after = feed.filter(F.col("last_updated") >= split).withColumn("ym", F.date_format("last_updated", "yyyyMM"))
    after.write.partitionBy("ym").parquet(src)
    stream = spark.readStream.schema(after.schema).option("maxFilesPerTrigger", 8).parquet(src)
    M1.refresh_stream(stream, catalogue, ckpt, cols=cols, order=order)
    return catalogue.read(after.select(*keys, *cols).schema)


def _requests(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return e.select(F.lower(F.trim(F.concat_ws("_", "event_type", F.col("user_id").cast("string")))).alias("cache_key"),
                    "event_id", F.col("ts").cast("timestamp").alias("ts"))


_REQ_SQL = ("SELECT lower(trim(event_type || '_' || CAST(user_id AS VARCHAR))) AS cache_key, event_id, ts FROM events")


@query("stream_reuse", sql=f"WITH requests AS ({_REQ_SQL}) {M2.suppress_batch_sql()}")
def stream_reuse(spark, sf_dir):
    """M2: each request flagged hit/miss by per-key event-time state (TTL 3600 s).

    The requests are replayed from files that hold them in no order, a few a trigger, so
    every trigger is behind the newest request by anything up to the whole log: the
    watermark allows for that. A heartbeat, written last, moves it past the log's end, and
    everything that waits is drained in time order."""
    base = M1.staging_path(spark, "reuse")
    src, out, ckpt = os.path.join(base, "requests"), os.path.join(base, "out"), os.path.join(base, "_checkpoint")
    r = _requests(spark, sf_dir)
    r.repartition(6, F.xxhash64("event_id")).write.parquet(src)
    r.agg(F.lit("").alias("cache_key"), F.lit(-1).cast("long").alias("event_id"),
          (F.max("ts") + F.expr(f"INTERVAL {2 * ORDER_DAYS} DAYS")).alias("ts")).write.mode("append").parquet(src)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", M2.STATE_STORE)
    try:
        stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 3).parquet(src)
        q = (M2.suppress_stream(stream, f"{ORDER_DAYS} days").where("event_id >= 0").writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(M2.OUTPUT_SCHEMA).parquet(out)
