"""Hand-made edge rows for the price/title/filter/TTL rules."""

from pyspark.sql import functions as F

from pricelens.functions import prices as PR
from pricelens.functions import rules
from pricelens.functions import titles as TI
from pricelens.operators import compare as C
from pricelens.operators import reuse as R


def test_numeric_price_edges(spark):
    vals = ["GH₵1,200.50", "₵ 49", "1.2.3", ".", "", None, "12,00", "1200.5", "5 $", "abc"]
    want = [1200.5, 49.0, 0.0, 0.0, 0.0, 0.0, 1200.0, 1200.5, 5.0, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(PR.numeric_price(F.col("v"))).collect()]
    assert got == want


def test_site_price_range_and_order(spark):
    vals = ["₵ 49 ₵ 50", "GH₵100000", "GH₵100,000.01 ₵ 60", "$0.5 $2.00", "nothing"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [tuple(r) for r in df.select(TI.site_price_text(F.col("v"), "jiji"), TI.site_price_text(F.col("v"), "aliexpress")).collect()]
    assert got == [("50", None), ("100000", None), ("60", None), (None, "2.00"), (None, None)]


def test_title_cleaning_quirk_and_validity(spark):
    df = spark.createDataFrame([("Nice  laptop  GH₵ 500",), ("12345",), ("oneword",), ("call",), ("Ok go",)], "v string")
    rows = df.select(TI.final_title(F.col("v"), "jiji").alias("t"), TI.valid_title(F.col("v")).alias("ok")).collect()
    assert rows[0]["t"] == "Nice laptop GH"   # '₵' rule runs before 'GH₵' (kept as is)
    assert [r["ok"] for r in rows] == [True, False, False, False, True]


def test_filters(spark):
    offers = spark.createDataFrame([(1, "open box", 5.0, "jiji"), (1, "pen", 0.0, "ebay"), (2, "desk lamp", 10.0, "jumia"),
                                    (3, "anything", 1.0, "jiji")], "query_id long, title string, price double, site_key string")
    searches = spark.createDataFrame([(1, "office", 0.0, None, []), (2, "nope", None, 9.0, []), (3, None, None, None, ["ebay"])],
                                     "query_id long, category string, min_price double, max_price double, retailers array<string>")
    got = sorted((r["query_id"], r["title"]) for r in C.apply_filters(offers, searches).collect())
    # 'pen' is a substring of 'open'; min 0 keeps price 0; unknown category = no filter; retailer list filters
    assert got == [(1, "open box"), (1, "pen")]


def test_ttl_edges(spark):
    store = spark.createDataFrame([("a", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:00"), ("c", "2023-12-31 23:59:59")],
                                  "cache_key string, cached_at string").withColumn("cached_at", F.col("cached_at").cast("timestamp"))
    as_of = F.lit("2024-01-01 01:00:00").cast("timestamp")
    hits = {r["cache_key"]: r["hit"] for r in R.reuse_results(store.select("cache_key"), store, as_of).collect()}
    assert hits == {"a": True, "b": False, "c": False}     # 3599 s, 3600 s, 3601 s
    big = store.unionByName(spark.range(200).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("cache_key"),
                                                    as_of.alias("cached_at")))
    kept = {r["cache_key"] for r in R.evict(big, as_of).collect()}
    assert "b" in kept and "a" in kept and "c" not in kept  # exactly 3600 s is neither served nor evicted


def test_filters_apply_after_the_top_20(spark):
    # 20 cheap offers fail the min-price filter, 5 dearer ones would pass it: the result list is
    # cut to the 20 cheapest first, so nothing survives (the filter must not move below the limit)
    rows = [(1, f"item {i}", float(i), 0, i) for i in range(25)]
    offers = spark.createDataFrame(rows, "query_id long, title string, price double, site_ord int, pos int") \
        .withColumn("site_key", F.lit("jiji"))
    searches = spark.createDataFrame([(1, None, 20.0, None, [])],
                                     "query_id long, category string, min_price double, max_price double, retailers array<string>")
    out = C.apply_filters(C.cheapest(offers, 20), searches)
    assert out.count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Window")  # filter sits above the window limit


def test_entity_offsets(spark):
    import re
    from pricelens.functions import entities as EN
    texts = ["Red Widget Brand 3 SMALL $12.50 price: 9", "plain", "", "12$ and 12$ then $12\nBlue bolt, economy size\nnext", "₵5 ₵5₵5 price ₵5", "é🙂 Price: $1,234.00 x\n" * 3,
             "\x01odd\x02 $5 \x01$6\x02 and 7₵", "2 price 2 $2", "Some long title text here\n$5"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", EN.entities(F.col("t")).alias("e")).collect():
        t, want = texts[r["i"]], []
        for group, patterns in (("TITLE", rules.ENTITY_TITLE_PATTERNS), ("PRICE", rules.ENTITY_PRICE_PATTERNS)):
            for p in patterns:
                want += [(group, m[1].strip(), m.start(), m.end()) for m in re.finditer(p, t, re.I | (re.M if group == "TITLE" else 0))]
        assert [(e["entity_group"], e["word"], e["start"], e["end"]) for e in r["e"]] == want, t


def test_conversion_with_a_table_of_rates(spark):
    from pricelens.operators import extract as X
    df = spark.createDataFrame([(1, 10.0, "USD"), (2, 3.0, "EUR"), (3, 5.0, ""), (4, None, "USD"), (5, 1.0, None)], "id int, amount double, currency string")
    rates = spark.createDataFrame([("USD", 10.85), ("GHS", 1.0)], "currency string, rate double")
    got = {r.id: r.amount_ghs for r in X.convert_currency(df, rates).collect()}
    assert got == {1: 108.5, 2: 3.0, 3: 5.0, 4: None, 5: 1.0}


def test_as_of_lookups(spark):
    import random
    from datetime import datetime, timedelta
    from pricelens.operators import reuse as R
    rng = random.Random(2)
    base = datetime(2024, 1, 1)
    moment = lambda: base + timedelta(seconds=rng.randint(0, 5 * 86_400), microseconds=rng.choice([0, 1]))
    store = [(rng.choice(["hot", "hot", "a", "b"]), moment(), float(i), i) for i in range(300)]
    store += [("hot", store[0][1], 1000.0, 1000), (None, base, 1.0, 1001), ("a", None, 1.0, 1002)]
    looks = [(rng.choice(["hot", "a", "b", "none"]), rng.choice([moment(), store[rng.randint(0, 299)][1]]), i) for i in range(400)]
    looks += [(None, base, 400), ("a", None, 401), ("hot", base - timedelta(days=9), 402), ("hot", base + timedelta(days=400), 403), ("hot", base + timedelta(days=400), 403)]
    s = spark.createDataFrame(store, "cache_key string, cached_at timestamp, payload double, event_id long")
    lk = spark.createDataFrame(looks, "cache_key string, at timestamp, id long")
    for seconds in (86_400, 600, 10 ** 9):
        got = sorted((r.id, r.payload, r.hit) for r in R.reuse_asof(lk, s, tie="event_id", slice_seconds=seconds).collect())
        want = []
        for k, at, i in looks:
            own = [(t, e, p) for kk, t, p, e in store if kk == k and k is not None and t is not None and at is not None and t <= at]
            best = max(own, default=None)
            want.append((i, best and best[2], bool(best) and (at - best[0]).total_seconds() < rules.CACHE_TTL_SECONDS))
        assert got == sorted(want, key=lambda x: (x[0], x[1] or 0)), seconds
