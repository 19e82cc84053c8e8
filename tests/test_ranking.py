"""Relevance closed form vs a general TF-IDF restatement; greedy near-duplicate walk."""

import random

from pyspark.sql import functions as F

from pricelens.functions import rules
from pricelens.functions.relevance import relevance
from pricelens.operators import ranking as RK
from tests import restate

random.seed(3)
VOC = ["small", "ring", "brand", "red", "widget", "the", "and", "of", "a", "economy", "blue", "bolt", "x", "hot"]


def _phrase(lo=0, hi=7):
    return " ".join(random.choice(VOC) for _ in range(random.randint(lo, hi)))


def test_relevance_matches_general_formula(spark):
    pairs = [(_phrase(), _phrase()) for _ in range(500)] + [("", ""), ("the and", "the"), ("small ring", "")]
    df = spark.createDataFrame([(i, t, q) for i, (t, q) in enumerate(pairs)], "i int, t string, q string")
    for r in df.select("i", relevance(F.col("t"), F.col("q")).alias("r")).collect():
        t, q = pairs[r["i"]]
        assert abs(r["r"] - restate.relevance(t, q)) < 1e-9, (t, q)


def test_dedupe_equals_greedy_walk(spark):
    groups = {g: [_phrase(1, 5) for _ in range(random.randint(1, 15))] for g in range(60)}
    groups[999] = ["red widget a", "red widget b", "red widget b c", "blue bolt"]  # a chain
    rows = [(g, k + 1, t) for g, ts in groups.items() for k, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "query_id long, rank long, title string")
    got = {}
    for r in RK.dedupe_offers(df).collect():
        got.setdefault(r["query_id"], []).append(r["rank"] - 1)
    for g, ts in groups.items():
        assert sorted(got.get(g, [])) == restate.greedy_dedupe(ts), (g, ts)


def test_site_budget(spark):
    # site 0 has 3 valid of its first 4, site 1 gets the remaining budget, site 2 nothing
    rows = [(1, 0, p, True) for p in (0, 1, 3, 7)] + [(1, 1, p, True) for p in range(10)] + [(1, 2, 0, True)]
    df = spark.createDataFrame(rows, "query_id long, site_ord int, pos int, valid boolean")
    got = sorted((r["site_ord"], r["pos"]) for r in RK.site_budget(df, n=5).collect())
    # site 0: budget 5 -> positions 0,1,3 (3 taken); site 1: budget 2 -> 0,1; site 2: budget 0
    assert got == [(0, 0), (0, 1), (0, 3), (1, 0), (1, 1)]


def test_skew_safe_row_number_matches_window(spark):
    from pyspark.sql import Window
    from pricelens.operators.windows import skew_safe_row_number
    # one hot key with most rows, many small keys
    df = spark.range(0, 20000).select((F.when(F.col("id") % 3 != 0, F.lit(0)).otherwise(F.col("id") % 97)).alias("k"),
                                      ((F.col("id") * 7919) % 10007).alias("v"), F.col("id"))
    got = skew_safe_row_number(df.repartition(8), "k", ["v", "id"], "rn")
    want = df.withColumn("rn2", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")))
    bad = got.join(want, ["k", "v", "id"]).filter(F.col("rn") != F.col("rn2")).count()
    assert bad == 0 and got.count() == 20000


def test_dedupe_empty_and_stopword_titles(spark):
    groups = {1: ["", "the", "red widget", "", "a of", "red widget x"], 2: ["the and", "the and", "blue"],
              3: ["x", "", "x"], 4: ["small ring", "", "small ring brand"]}
    rows = [(g, k + 1, t) for g, ts in groups.items() for k, t in enumerate(ts)]
    got = {}
    for r in RK.dedupe_offers(spark.createDataFrame(rows, "query_id long, rank long, title string")).collect():
        got.setdefault(r["query_id"], []).append(r["rank"] - 1)
    for g, ts in groups.items():
        assert sorted(got.get(g, [])) == restate.greedy_dedupe(ts)


def test_dedupe_large_groups_and_titles_without_terms(spark):
    rng = random.Random(5)
    bare = ["a", "the", "of a", "a b c d e f", "a b c d e", "-- a --", "the the the the and", "and", "a-b", "-", "--", "---", "b c d e f g", "is it", "₵", "to be or not to be"]
    groups = {1: [" ".join(rng.choice(VOC) + rng.choice(["", "", str(rng.randint(0, 3))]) for _ in range(rng.randint(1, 9))) for _ in range(500)],
              2: [" ".join(rng.choice(bare) for _ in range(rng.randint(1, 4))) for _ in range(120)] + ["red " * 9, "red", "red red", "RED"],
              3: [f"red widget {i}" for i in range(300)], 4: ["blue bolt " + "x y " * i for i in range(40)]}
    rows = [(g, k + 1, t) for g, ts in groups.items() for k, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "query_id long, rank long, title string").repartition(3)
    got = {}
    for r in RK.dedupe_offers(df).collect():
        got.setdefault(r["query_id"], []).append(r["rank"] - 1)
    for g, ts in groups.items():
        assert sorted(got[g]) == restate.greedy_dedupe(ts), g
    assert RK.dedupe_offers(df.limit(0)).count() == 0


def test_shared_part_bounds_similar_pairs(spark):
    """The prefix bound: what similar titles share is more than ``SHARED_PART`` of either."""
    from collections import Counter
    rng = random.Random(7)
    seen = 0
    for _ in range(4000):
        a = [rng.choice(VOC) for _ in range(rng.randint(1, 6))]
        b = " ".join(a[:rng.randint(1, 6)] + [rng.choice(VOC) for _ in range(rng.randint(0, 3))])
        a = " ".join(a)
        if restate.relevance(b, a) > rules.DUPLICATE_ABOVE and restate._grams(a) and restate._grams(b):
            ca, cb = Counter(restate._grams(a)), Counter(restate._grams(b))
            for c, o in ((ca, cb), (cb, ca)):
                seen += 1
                assert sum(v * v for t, v in c.items() if t in o) > RK.SHARED_PART * sum(v * v for v in c.values())
    assert seen > 500
