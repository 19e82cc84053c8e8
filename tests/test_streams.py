"""Streams equal their batch definitions; state in any order of arrival; files that a batch leaves alone."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from pricelens.functions import rules
from pricelens.streaming import refresh as M1, reuse as M2
from tests.conftest import SMALL

TTL = rules.CACHE_TTL_SECONDS * 1_000_000


def sequential(rows):
    """event id -> hit, walking each key's requests in time order."""
    want, last = {}, {}
    for k, t, e in sorted(rows):
        want[e] = k in last and t - last[k] < TTL
        if not want[e]:
            last[k] = t
    return want


def test_refresh_stream_equals_batch_upsert(spark):
    q = E.queries()
    a = q["stream_refresh"](spark, SMALL)
    b = q["upsert_prices"](spark, SMALL)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_reuse_stream_equals_sequential_rule(spark):
    got = {r["event_id"]: r["hit"] for r in E.queries()["stream_reuse"](spark, SMALL).collect()}
    ev = (spark.read.parquet(f"{SMALL}/events.parquet")
          .select(F.lower(F.trim(F.concat_ws("_", "event_type", F.col("user_id").cast("string")))).alias("k"),
                  F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id").collect())
    assert got == sequential(ev)


def replay(spark, folder, files, order_within):
    """Each list of (key, microseconds, id) is a file, and a trigger of its own, in the order given."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", M2.STATE_STORE)
    schema = "cache_key string, event_id long, ts timestamp"
    out = os.path.join(folder, "out")
    for i, rows in enumerate(files):
        src = os.path.join(folder, "src")
        (spark.createDataFrame([(k, e, t) for k, t, e in rows], "cache_key string, event_id long, t long")
         .select("cache_key", "event_id", F.timestamp_micros("t").alias("ts")).coalesce(1).write.mode("append").parquet(src))
        q = (M2.suppress_stream(spark.readStream.schema(schema).parquet(src), order_within).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", os.path.join(folder, "ckpt")).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    rows = spark.read.schema(M2.OUTPUT_SCHEMA).parquet(out).where("event_id >= 0").select("event_id", "hit", F.unix_micros("ts").alias("t")).collect()
    assert len(rows) == len({r.event_id for r in rows})
    return {r.event_id: r.hit for r in rows}, {r.event_id: r.t for r in rows}


def test_requests_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    base = 1_700_000_000_000_000
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 3)}", base + rng.randint(0, 6 * 3600) * 1_000_000 + rng.choice([0, 1, 999_999]), i) for i in range(300)]
    rows += [("hot", base + TTL, 300), ("hot", base + TTL, 301)]  # ties in time
    rng.shuffle(rows)
    beat = [("", base + 48 * 3600 * 1_000_000, -1)]
    got, times = replay(spark, str(tmp_path), [rows[:100], rows[100:200], rows[200:], beat], "12 hours")
    assert got == sequential(rows) and times == {e: t for _, t, e in rows}


def test_late_requests_are_kept(spark, tmp_path):
    base = 1_700_000_000_000_000
    hour = 3_600_000_000
    first = [("a", base, 0), ("a", base + hour // 2, 1), ("b", base, 2), ("", base + 10 * hour, -1)]
    late = [("a", base + hour // 4, 3), ("a", base - hour, 4), ("a", base + 2 * hour, 5), ("c", base, 6), ("", base + 30 * hour, -2)]
    got, _ = replay(spark, str(tmp_path), [first, late], "1 hour")
    assert set(got) == set(range(7))  # none is dropped
    assert [got[i] for i in range(3)] == [False, True, False] and not got[6]


def snapshot(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs
            if f.endswith(".parquet") and os.sep + "gen-" in d + os.sep}


@pytest.fixture()
def catalogue(spark, tmp_path):
    c = M1.Catalogue(spark, str(tmp_path / "cat"), ["k"], rows_per_file=100)
    c.load(spark.range(2000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(0).alias("o")))
    return c


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k long, v string, o int")


def test_a_batch_rewrites_only_the_files_of_its_keys(spark, catalogue):
    before = snapshot(catalogue.root)
    assert len(before) == 20
    keys = [5, 6, 7, 8, 9, 1500, 1501, 1502, 1503, 1504]
    gone = catalogue.upsert(rows(spark, [(k, "new", 1) for k in keys] + [(9999, "added", 1)]), 0, ["o"], ["v"])
    after = snapshot(catalogue.root)
    assert 1 <= len(gone) <= 4
    kept = {p: t for p, t in before.items() if p in after}
    assert len(kept) == 20 - len(gone) and all(after[p] == t for p, t in kept.items())
    got = {r.k: r.v for r in catalogue.read("k long, v string, o int").collect()}
    assert got == {k: "new" if k in keys else "old" for k in range(2000)} | {9999: "added"}


def test_a_batch_is_applied_once_whatever_fails(spark, catalogue, monkeypatch):
    batch = rows(spark, [(3, "new", 1), (3, "older", 0), (777, "new", 2)])
    want = {k: "new" if k in (3, 777) else "old" for k in range(2000)}
    read = lambda: {r.k: r.v for r in catalogue.read("k long, v string, o int").collect()}
    move = type(catalogue)._write
    monkeypatch.setattr(type(catalogue), "_write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):  # before the generation is in place: nothing has changed
        catalogue.upsert(batch, 7, ["o"], ["v"])
    assert read() == dict.fromkeys(range(2000), "old")
    monkeypatch.setattr(type(catalogue), "_write", move)
    monkeypatch.setattr(type(catalogue), "_finish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):  # in place, replaced files not yet removed: readers leave them out
        catalogue.upsert(batch, 7, ["o"], ["v"])
    assert read() == want and catalogue.read("k long, v string, o int").count() == 2000
    monkeypatch.undo()
    files = len(snapshot(catalogue.root))
    catalogue.upsert(batch, 7, ["o"], ["v"])  # replayed
    assert read() == want and len(snapshot(catalogue.root)) < files
    catalogue.upsert(rows(spark, [(3, "stale", 0)]), 8, ["o"], ["v"])  # an older observation changes nothing
    assert read() == want


def test_a_batch_all_over_the_catalogue_rewrites_nothing(spark, catalogue):
    before = snapshot(catalogue.root)
    spread = spark.range(0, 2000, 4).select(F.col("id").alias("k"), F.lit("new").alias("v"), F.lit(2).alias("o"))
    assert catalogue.upsert(spread.union(spread), 0, ["o"], ["v"]) == []
    after = snapshot(catalogue.root)
    assert all(after[p] == t for p, t in before.items())
    read = lambda: {r.k: r.v for r in catalogue.read("k long, v string, o int").collect()}
    want = {k: "new" if k % 4 == 0 else "old" for k in range(2000)}
    assert read() == want and catalogue.read("k long, v string, o int").count() == 2000
    assert catalogue.upsert(spread, 0, ["o"], ["v"]) == [] and snapshot(catalogue.root) == after  # replayed
    assert catalogue.upsert(rows(spark, [(4, "stale", 1), (5, "newer", 3), (9999, "added", 0)]), 1, ["o"], ["v"]) == []
    want |= {5: "newer", 9999: "added"}
    assert read() == want


def test_as_many_rows_beside_as_clustered_are_settled_once(spark, catalogue, monkeypatch):
    read = lambda: {r.k: r.v for r in catalogue.read("k long, v string, o int").collect()}
    batch = lambda i: spark.range(i % 2, 2000, 2).select(F.col("id").alias("k"), F.lit(f"v{i}").alias("v"), F.lit(i).alias("o"))
    assert catalogue.upsert(batch(1), 1, ["o"], ["v"]) == []
    finish = type(catalogue)._finish
    monkeypatch.setattr(type(catalogue), "_finish", lambda self, g: (_ for _ in ()).throw(OSError("lost")) if g.endswith("settled") else finish(self, g))
    with pytest.raises(OSError):  # settled, what it replaces not yet removed
        catalogue.upsert(batch(2), 2, ["o"], ["v"])
    want = {k: "v1" if k % 2 else "v2" for k in range(2000)}
    assert read() == want and catalogue.read("k long, v string, o int").count() == 2000
    monkeypatch.undo()
    assert catalogue.upsert(batch(2), 2, ["o"], ["v"])  # replayed
    assert read() == want and not catalogue.beside(catalogue.files())
    assert {p.split("gen-")[1].split(os.sep)[0] for p in snapshot(catalogue.root)} == {"2-settled"}
    kept = snapshot(catalogue.root)
    gone = catalogue.upsert(rows(spark, [(3, "last", 9)]), 3, ["o"], ["v"])  # few keys: a rewrite again
    assert len(gone) == 1 and sum(p in snapshot(catalogue.root) for p in kept) == len(kept) - 1
    assert read() == want | {3: "last"}
