"""Labels and pieces worked out for a batch of rows together, and the same rows as one by one."""

import random
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as E
from pricelens.operators import training as TR
from tests.conftest import SMALL

random.seed(23)
WORDS = ["", "a", "ab", "abab", "é🙂é", "$12.50", "https://shop/item/1", "x" * 40, "[a]", "a.b\\c"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_regex_or_lambda_for_each_word_or_position(spark):
    p = plan(E.queries()["align_labels"](spark, SMALL))
    assert p.count("ArrowEvalPython [") == 3 and "regexp_extract_all" not in p
    assert p.count("lambdafunction") == plan(E.queries()["annotate_offers"](spark, SMALL)).count("lambdafunction")


def test_words_are_grouped_after_their_counts(spark):
    p = plan(TR.word_counts(spark.createDataFrame([(["a", "b"],)], "tokens array<string>")))
    assert "MapInArrow" in p and "Generate" not in p


def test_runs_are_cut_after_the_longest_are_counted(spark):
    p = plan(TR.vocabulary(spark.createDataFrame([("abcd", 1)], "word string, n long")))
    assert "lambdafunction" not in p and p.count("Generate") == 2 and p.count("Exchange hashpartitioning") == 2


def test_word_counts(spark, monkeypatch):
    rows = [(None,), ([],)] + [([random.choice(WORDS) for _ in range(random.randint(0, 9))],) for _ in range(300)]
    df = spark.createDataFrame(rows, "tokens array<string>").repartition(3)
    for held in (TR.COUNTED_TOKENS, 50):
        monkeypatch.setattr(TR, "COUNTED_TOKENS", held)
        got = [(r.word, r.n) for r in TR.word_counts(df).collect()]
        assert sorted(got) == sorted(Counter(w for t, in rows for w in t or []).items())
    assert TR.word_counts(df.limit(0)).count() == 0


def test_word_ids_as_by_a_table_of_pieces(spark, monkeypatch):
    rows = [(i, [random.choice(WORDS) for _ in range(random.randint(0, 9))]) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>").withColumn("labels", F.transform("tokens", lambda t: F.lit(0))).repartition(3)
    vocab = spark.createDataFrame([(p,) for p in ("ab", "aba", "🙂é", "https://", ".5", "xxxxxx", "a]", ".b\\")], "piece string")
    pieces = TR.word_pieces(spark.createDataFrame([(w,) for w in WORDS], "word string"), vocab)
    want = {r.id: r.word_ids for r in TR.with_word_ids(df, pieces, ["id"]).collect()}
    for known in (TR.KNOWN_WORDS, 2):
        monkeypatch.setattr(TR, "KNOWN_WORDS", known)
        ids = TR.word_ids(F.col("tokens"), TR.piece_pattern(vocab))
        assert {r.id: r.w for r in df.select("id", ids.alias("w")).collect()} == want
    odd = spark.createDataFrame([(1, None), (2, ["a", None]), (3, ["abab", ""])], "id int, tokens array<string>")
    assert {r.id: r.w for r in odd.select("id", TR.word_ids(F.col("tokens"), TR.piece_pattern(vocab)).alias("w")).collect()} == {1: None, 2: None, 3: [0, 0, 1]}


def test_odd_texts_are_labelled_as_segment_by_segment(spark):
    table = {None: (None, None), "": ([], []), " \n": ([], []), "\u0001": ([], []),
             "a\u0001b c\u0002d [PRICE]1  2\t3[/PRICE]e": (["a", "d", "1", "2", "3", "e"], [0, 0, 3, 4, 4, 0]),
             "[IMG] i [/IMG][URL]\u0002u[/URL] [TITLE][PRICE]5[/PRICE][/TITLE]": (["i", "\u0002u", "[PRICE]5[/PRICE]"], [7, 5, 1])}
    df = spark.createDataFrame(list(enumerate(table)), "i int, t string").repartition(2)
    for r in df.select("t", TR.bio_labels(F.col("t")).alias("b")).collect():
        assert (r.b.tokens, r.b.labels) == table[r.t], r.t


def test_aligned_parts_of_odd_rows(spark):
    pad = lambda *x: [-100, *x] + [-100] * (5 - len(x))
    rows = [(1, [0, 0, 1, 1, 1, 2], [5, 6, 7], [pad(5, -100, 6, -100), pad(-100, 7)]), (2, [], [1], [pad()]), (3, [0, 4], [9], [pad(9, 0)]),
            (4, [0, 1], None, [pad(0, 0)]), (5, None, [1], [None]), (6, [0, 1], [None, 3], [pad(0, 3)]), (7, [1, None, 1], [8, 9], [pad(9, -100, -100)])]
    df = spark.createDataFrame([r[:3] for r in rows], "id int, w array<int>, l array<int>").repartition(2)
    assert {r.id: r.p for r in df.select("id", TR.aligned_parts(F.col("w"), F.col("l"), 6).alias("p")).collect()} == {r[0]: r[3] for r in rows}


def test_text_of_a_sequence(spark):
    df = spark.createDataFrame([([-100, 3, -100, 4, -100, -100],), ([-100],), ([],)], "a array<int>")
    for used in (4, 6, 99):
        assert [r.t for r in df.select(TR.labels_text(F.col("a"), F.lit(used)).alias("t")).collect()] == ["-100,3,-100,4,-100,-100", "-100", ""]
