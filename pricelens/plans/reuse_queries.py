"""Result-reuse queries (K1-K5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import reuse as R
from ..sources import fixtures as fx
from .registry import query

def _as_of():
    return F.lit(fx.AS_OF).cast("timestamp")


AS_OF_SQL = f"TIMESTAMP '{fx.AS_OF}'"
TTL = rules.CACHE_TTL_SECONDS
AGE_SQL = f"((epoch_us({AS_OF_SQL}) - epoch_us(cached_at)) / 1000000.0)"
LATEST_SQL = f"""SELECT cache_key, cached_at, payload, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY cached_at DESC, event_id DESC) AS rn
  FROM result_store {{where}}) t WHERE rn = 1"""


def _num_sql(x: str, default: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = 0 THEN '{default}' ELSE CAST({x} AS VARCHAR) END"


@query("cache_key", sql=f"""SELECT query_id, lower(trim(concat_ws('_', query,
    CASE WHEN category IS NULL OR category = '' THEN 'all' ELSE category END,
    {_num_sql('min_price', '0')}, {_num_sql('max_price', '99999')},
    CASE WHEN coalesce(len(retailers), 0) > 0 THEN array_to_string(list_sort(retailers), '-') ELSE 'all' END)))
    AS cache_key FROM searches""", fixtures=["searches"])
def cache_key(spark, sf_dir):
    """K1: reuse key of each search (query, category, price range, retailers)."""
    s = fx.searches(spark, sf_dir)
    return s.select("query_id", R.cache_key(F.col("query"), F.col("category"), F.col("min_price"),
                                            F.col("max_price"), F.col("retailers")).alias("cache_key"))


@query("reuse_results", sql=f"""SELECT k.cache_key, l.cached_at, l.payload,
  coalesce({AGE_SQL.replace('cached_at', 'l.cached_at')} < {TTL}, FALSE) AS hit
  FROM (SELECT DISTINCT cache_key FROM result_store) k
  LEFT JOIN ({LATEST_SQL.format(where=f"WHERE cached_at <= {AS_OF_SQL}")}) l USING (cache_key)""",
       fixtures=["result_store"])
def reuse_results(spark, sf_dir):
    """K2: per key, the newest entry as of the run time and whether it is still fresh."""
    store = fx.result_store(spark, sf_dir)
    lookups = store.select("cache_key").distinct()
    r = R.reuse_results(lookups, store, _as_of(), tie="event_id")
    return r.select("cache_key", "cached_at", "payload", "hit")


@query("reuse_asof", sql=f"""WITH store AS (SELECT cache_key, cached_at, max(event_id) AS stored_id, arg_max(payload, event_id) AS payload FROM result_store GROUP BY ALL),
  lookups AS (SELECT cache_key, event_id AS lookup_id, cached_at + to_seconds(900 * (event_id % 11) - 4000) AS looked_at FROM result_store)
  SELECT l.cache_key, lookup_id, looked_at, s.cached_at, s.payload, coalesce(s.stored_id, -1) AS stored_id, coalesce((epoch_us(looked_at) - epoch_us(s.cached_at)) / 1000000.0 < {TTL}, FALSE) AS hit
  FROM lookups l ASOF LEFT JOIN store s ON l.cache_key = s.cache_key AND l.looked_at >= s.cached_at""", fixtures=["result_store"])
def reuse_asof(spark, sf_dir):
    """K2: look-ups at times of their own (some before, some after the events they come from) against the whole result store."""
    store = fx.result_store(spark, sf_dir)
    at = F.timestamp_micros(F.unix_micros(F.col("cached_at").cast("timestamp")) + (900 * (F.col("event_id") % 11) - 4000) * 1_000_000)
    lookups = store.select("cache_key", F.col("event_id").alias("lookup_id"), at.alias("looked_at"))
    found = R.reuse_asof(lookups, store.withColumnRenamed("event_id", "stored_id"), at="looked_at", tie="stored_id")
    return found.withColumn("stored_id", F.coalesce("stored_id", F.lit(-1).cast("long")))


@query("latest_per_key", sql=f"SELECT cache_key, cached_at, payload FROM ({LATEST_SQL.format(where='')}) x",
       fixtures=["result_store"])
def latest_per_key(spark, sf_dir):
    """K3: store compaction -- a put replaces the entry for its key."""
    return R.latest_per_key(fx.result_store(spark, sf_dir), tie="event_id").select("cache_key", "cached_at", "payload")


@query("evict_expired", sql=f"""WITH cur AS ({LATEST_SQL.format(where=f"WHERE cached_at <= {AS_OF_SQL}")})
  SELECT cache_key, cached_at FROM cur WHERE {AGE_SQL} <= {TTL}""", fixtures=["result_store"])
def evict_expired(spark, sf_dir):
    """K4: clean-up of the store: entries older than the TTL are removed."""
    store = fx.result_store(spark, sf_dir)
    cur = R.latest_per_key(store.filter(F.col("cached_at") <= _as_of()), tie="event_id")
    return R.evict(cur, _as_of()).select("cache_key", "cached_at")


@query("invalidate", sql=f"""SELECT cache_key, cached_at FROM ({LATEST_SQL.format(where='')}) x
  WHERE cache_key NOT IN (SELECT DISTINCT lower(trim(event_type || '_' || CAST(user_id AS VARCHAR)))
                          FROM events WHERE user_id % 10 = 0)""", fixtures=["result_store"])
def invalidate(spark, sf_dir):
    """K5: entries of the given keys are dropped (here: every key of users whose id ends in 0)."""
    from ..sources.tables import load
    store = R.latest_per_key(fx.result_store(spark, sf_dir), tie="event_id")
    e = load(spark, sf_dir, "events").filter(F.col("user_id") % 10 == 0)
    keys = e.select(F.lower(F.trim(F.concat_ws("_", "event_type", F.col("user_id").cast("string")))).alias("cache_key"))
    return R.invalidate(store, keys).select("cache_key", "cached_at")
