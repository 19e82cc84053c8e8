"""Result reuse with a time-to-live (K1-K5).

The result store is a table of (cache_key, cached_at, payload) versions.
"Latest entry per key" is a ``max_by`` aggregation (map-side partial
aggregation, skew-safe); freshness is an age predicate against an ``as_of``
time passed in by the caller, so runs are reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.prices import number_text


def _num_text(x: Column, default: str) -> Column:
    """Python's ``str(x or default)`` for an optional float (0 and NULL give the default)."""
    return F.when(x.isNull() | (x == 0), F.lit(default)).otherwise(number_text(x.cast("double")))


def cache_key(query: Column, category: Column, min_price: Column, max_price: Column,
              retailers: Column) -> Column:
    """``query_category_min_max_retailers``, normalised (lower-case, trimmed).

    Empty category -> 'all'; missing/zero min -> 0; missing/zero max -> 99999;
    retailers sorted and joined by '-', or 'all'.
    """
    cat = F.when(category.isNull() | (category == ""), F.lit("all")).otherwise(category)
    ret = F.when(F.coalesce(F.size(retailers), F.lit(0)) > 0, F.array_join(F.array_sort(retailers), "-")) \
        .otherwise(F.lit("all"))
    raw = F.concat_ws("_", query, cat, _num_text(min_price, "0"), _num_text(max_price, "99999"), ret)
    return F.lower(F.trim(raw))


def _age_seconds(as_of: Column, t: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(t.cast("timestamp"))) / F.lit(1_000_000.0)


def latest_per_key(store: DataFrame, key: str = "cache_key", ts: str = "cached_at",
                   tie: str | None = None) -> DataFrame:
    """K3: the store after puts -- one (newest) entry per key."""
    cols = [c for c in store.columns if c != key]
    order = F.struct(F.col(ts), *([F.col(tie)] if tie else []))
    return (store.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), order).alias("_r"))
            .select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]))


def reuse_results(lookups: DataFrame, store: DataFrame, as_of: Column, key: str = "cache_key",
                  ts: str = "cached_at", tie: str | None = None) -> DataFrame:
    """K2: for each lookup key, the newest entry cached at or before ``as_of``;
    a hit iff its age is strictly below the TTL."""
    visible = store.filter(F.col(ts) <= as_of)
    latest = latest_per_key(visible, key, ts, tie)
    j = lookups.join(latest, key, "left")
    age = _age_seconds(as_of, F.col(ts))
    return j.withColumn("hit", F.coalesce(age < rules.CACHE_TTL_SECONDS, F.lit(False)))


def reuse_asof(lookups: DataFrame, store: DataFrame, key: str = "cache_key", at: str = "at",
               ts: str = "cached_at", tie: str | None = None, slice_seconds: int = 86_400) -> DataFrame:
    """K2 with each look-up's own time: the newest entry of its key cached at or before ``at``; a
    hit iff its age is strictly below the TTL. The columns of ``lookups`` and of ``store``, and ``hit``.

    An as-of join: both sides are united, and the last entry is carried forward in time. A key's rows are cut into time slices,
    so that no task sorts a hot key: inside a slice a window carries, and what a slice starts
    with is the last entry of the slices before it (an aggregate, one row a slice). Look-ups without a key or a time find nothing.
    """
    cols, own = [c for c in store.columns if c != key], [c for c in lookups.columns if c != key]
    order = [F.col(ts), *([F.col(tie)] if tie else [])]
    s = store.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        key, F.col(ts).cast("timestamp").alias("_t"), F.lit(0).alias("_kind"), F.struct(*order).alias("_o"), F.struct(*cols).alias("_v"))
    none = {c: F.lit(None).cast(s.schema[c].dataType) for c in ("_o", "_v")}
    lk = lookups.select(key, F.col(at).cast("timestamp").alias("_t"), F.lit(1).alias("_kind"), none["_o"].alias("_o"), none["_v"].alias("_v"), F.struct(*own).alias("_l"))
    cut = F.floor(F.unix_micros("_t") / F.lit(slice_seconds * 1_000_000)).alias("_s")
    u = s.withColumn("_l", F.lit(None).cast(lk.schema["_l"].dataType)).unionByName(lk).select("*", cut)
    inside = Window.partitionBy(key, "_s").orderBy("_t", "_kind", "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = u.withColumn("_v", F.last("_v", ignorenulls=True).over(inside)).where("_kind = 1")
    ends = u.groupBy(key, "_s").agg(F.max_by("_v", F.when(F.col("_kind") == 0, F.col("_o"))).alias("_e"))
    earlier = Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(F.col(key).alias("_k"), F.col("_s").alias("_b"), F.last("_e", ignorenulls=True).over(earlier).alias("_e"))
    j = found.join(starts, F.col(key).eqNullSafe(F.col("_k")) & F.col("_s").eqNullSafe(F.col("_b")))
    v = F.coalesce("_v", "_e")
    age = _age_seconds(F.col("_t"), v[ts])
    return j.select(key, *[F.col("_l")[c].alias(c) for c in own], *[v[c].alias(c) for c in cols if c not in own],
                    F.coalesce(age < rules.CACHE_TTL_SECONDS, F.lit(False)).alias("hit"))


def evict(store: DataFrame, as_of: Column, ts: str = "cached_at") -> DataFrame:
    """K4: drop entries older than the TTL (strictly), whatever the size of the store; an entry
    aged exactly the TTL is neither served nor evicted."""
    return store.filter(_age_seconds(as_of, F.col(ts)) <= rules.CACHE_TTL_SECONDS)


def invalidate(store: DataFrame, keys: DataFrame | None = None, key: str = "cache_key") -> DataFrame:
    """K5: drop the given keys (anti join); with no keys, clear everything."""
    if keys is None:
        return store.limit(0)
    return store.join(keys.select(key).distinct(), key, "left_anti")
