"""What must not grow with the input: plans that send nothing large through the driver, work per distinct value."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["top_offers", "relevance", "rank_offers"])
def test_scores_of_parts_are_not_broadcast(spark, name):
    assert "BroadcastHashJoin" not in plan(E.queries()[name](spark, SMALL))


def test_equal_texts_are_scored_once(spark):
    from pricelens.plans.rank_queries import scored_texts
    parts = spark.range(0, 400).select(F.concat(F.lit("ring "), F.col("id") % 2).alias("p_name"), F.concat(F.lit("ring "), F.col("id") % 2, F.lit(" LARGE")).alias("title"))
    rows = scored_texts(parts).collect()
    assert len(rows) == 2 and all(len(r.desc_rel) == 5 and None not in (r.title_rel, r.reverse_rel, *r.desc_rel) for r in rows)


def test_words_are_cut_without_a_shuffle(spark):
    from pricelens.operators import training as TR
    words = spark.range(3).select(F.concat(F.lit("ab"), F.col("id")).alias("word"))
    assert "Exchange" not in plan(TR.word_pieces(words, spark.createDataFrame([("ab",)], "piece string")))


def test_json_lines_are_compressed(spark, tmp_path):
    from pricelens.operators import training as TR
    df = spark.range(9).selectExpr("concat('t', id) AS text", "'q' AS query", "'s' AS source", "'' AS timestamp", "map('k', 'v') AS product_data")
    TR.write_training_set(df, str(tmp_path / "x"))
    assert list((tmp_path / "x").rglob("*.json.gz")) and not list((tmp_path / "x").rglob("*.json"))
    assert sorted(r.text for r in TR.read_training_set(spark, str(tmp_path / "x")).collect()) == [f"t{i}" for i in range(9)]


def test_price_comparison_carries_no_urls(spark):
    assert "https://shop" not in plan(E.queries()["price_comparison"](spark, SMALL))


@pytest.mark.parametrize("name", ["relevance", "rank_offers"])
def test_offers_are_not_sorted_for_their_scores(spark, name):
    p = plan(E.queries()[name](spark, SMALL))
    assert "ShuffledHashJoin [l_partkey" in p and "SortMergeJoin [l_partkey" not in p


def test_titles_are_not_broadcast(spark):
    from pricelens.functions.relevance import terms
    from pricelens.operators import ranking as RK
    from pricelens.operators.windows import stored
    titles = spark.range(50).select(F.lit(1).cast("long").alias("query_id"), F.col("id").alias("rank"), F.concat(F.lit("red ring "), F.col("id")).alias("title"))
    p = plan(RK.similar_titles(stored(titles.withColumn("_t", terms(F.col("title"))), "titles-in-a-test"), "query_id", "rank"))
    assert "BroadcastHashJoin" not in p and "SortMergeJoin" in p
    assert "BroadcastHashJoin" not in plan(RK.dedupe_offers(titles))


def test_numbered_rows_are_joined_to_nothing(spark):
    from pricelens.operators.windows import skew_safe_row_number
    rows = spark.range(50).selectExpr("id % 3 AS k", "id / 7 AS v", "id", "concat('wide', id) AS text")
    for lead in (0, 1):
        assert not [x for x in plan(skew_safe_row_number(rows, "k", ["v", "id"], lead=lead)).splitlines() if "Join" in x and "text" in x]
    p = plan(skew_safe_row_number(rows, "k", ["v", "id"]))
    assert "Join" not in p
    assert plan(skew_safe_row_number(rows, "k", ["v", "id"], lead=1)).count("Join") == 1  # of counts, a row a slice each


def test_numbers_of_rows_with_nulls_and_ties_of_the_leading_columns(spark):
    from pyspark.sql import Window
    from pricelens.operators.windows import skew_safe_row_number
    df = spark.range(900).selectExpr("nullif(id % 4, 3) AS k", "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN double('NaN') WHEN id % 2 = 0 THEN -0.0D ELSE id % 11 - 4.5 END AS v",
                                     "nullif(id % 3, 2) AS site", "id * 37 % 911 AS id")
    order = ["v", "site", "id"]
    for lead in (0, 1, 2):
        got = skew_safe_row_number(df.repartition(5), "k", order, "rn", lead=lead)
        assert got.columns == ["k", "v", "site", "id", "rn"]
        want = {r.id: r.rn for r in df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*order))).collect()}
        assert {r.id: r.rn for r in got.collect()} == want and len(want) == got.count() == 900
