"""Ranking, budgets and de-duplication of offers.

"Earlier site fills first" is a fold over one array per search that holds at most ``n`` offers
of each site. "Walk in rank order" (near-duplicates) is a similarity join and rounds over its
pairs. Ranks are numbered without a per-search window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.regex import pystrip
from ..functions.relevance import IDF_ONE_SIDE_SQ, ROUND, score, terms, with_relevance
from .windows import skew_safe_row_number, stored


def _cols(cs: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def site_budget(candidates: DataFrame, n: int = rules.GENERIC_RESULT_CAP, key: str = "query_id",
                site: str = "site_ord", pos: str = "pos", valid: str = "valid") -> DataFrame:
    """R6 budget: sites are visited in order; site k may look at its first
    ``n - accepted so far`` candidates; visiting stops once ``n`` are accepted.
    Returns the accepted rows.

    One pass: each search's valid candidates (at most sites x chunk cap) are
    packed in (site, position) order and folded; the budget of a site is what
    is left when its first candidate is reached.
    """
    cols = [c for c in candidates.columns if c not in (key, valid)]
    # collect_list skips NULLs: invalid rows contribute nothing, and the validity
    # expression is evaluated once (a filter would be pushed below and re-run it)
    item = F.when(F.col(valid), F.struct(F.col(site).alias("_s"), F.col(pos).alias("_p"), F.struct(*cols).alias("_row")))
    packed = candidates.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    row_t = packed.schema["items"].dataType.elementType
    init = F.struct(F.lit(None).cast(row_t["_s"].dataType).alias("cur"), F.lit(n).alias("budget"),
                    F.lit(n).alias("left"), F.array().cast(f"array<{row_t.simpleString()}>").alias("kept"))

    def step(acc, x):
        new_site = acc["cur"].isNull() | (acc["cur"] != x["_s"])
        budget = F.when(new_site, acc["left"]).otherwise(acc["budget"])
        take = x["_p"] < budget
        return F.struct(x["_s"].alias("cur"), budget.alias("budget"),
                        F.when(take, acc["left"] - 1).otherwise(acc["left"]).alias("left"),
                        F.when(take, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    kept = packed.select(key, F.explode(F.aggregate("items", init, step)["kept"]).alias("x"))
    return kept.select(key, *[F.col(f"x._row.{c}").alias(c) for c in cols])


def rank_offers(offers: DataFrame, searches: DataFrame | None = None, key: str = "query_id",
                tie: Sequence[str] = ("site_ord", "pos")) -> DataFrame:
    """score = 0.7 * relevance(title) + 0.3 * relevance(description), descending, stable.

    Offers that already carry their search's ``query`` are not joined again.
    """
    j = offers if searches is None else offers.join(searches.select(key, "query"), key)
    j = with_relevance(with_relevance(j, "title", "query", "_rt"), "description", "query", "_rdsc")
    s = F.round(F.col("_rt") * rules.RANK_TITLE_WEIGHT + F.col("_rdsc") * rules.RANK_DESC_WEIGHT, ROUND)
    return number_by_score(j.withColumn("relevance_score", s).drop("_rt", "_rdsc", "query"), tie, key)


def number_by_score(scored: DataFrame, tie: Sequence[str], key: str = "query_id") -> DataFrame:
    """R3 over already scored offers (``relevance_score``): descending, stable on ``tie``; a
    search of any size is numbered by many tasks."""
    return skew_safe_row_number(scored.withColumn("_by", -F.col("relevance_score")), key, ["_by", *tie], "rank", lead=min(2, 1 + len(tie))).drop("_by")


# A pair above the threshold with all its words found still has a cosine of more than
# DUPLICATE_ABOVE - WORD_BOOST. Shared terms weigh 1, others IDF_ONE_SIDE, so the shared part of either
# side's squared counts is more than this share of all its squared counts.
_COS = rules.DUPLICATE_ABOVE - rules.WORD_BOOST
SHARED_PART = _COS ** 2 * IDF_ONE_SIDE_SQ / (1 - _COS ** 2 + _COS ** 2 * IDF_ONE_SIDE_SQ)


def _prefixes(titles: DataFrame, key: str, order: str) -> DataFrame:
    """``titles`` with the array ``_p``: each title's rarest terms (by the titles of the search
    that have them), as many as it takes for what is left to be too little of it. (Joins here and below
    are of two shuffled sides: a written table of texts is far smaller than its rows, the more so once
    they are exploded, and would be taken for small enough to go through the driver.)"""
    terms_of = titles.select(key, order, F.explode(F.arrays_zip(F.col("_t.uniq").alias("term"), F.col("_t.cnt").alias("cnt"))).alias("x")).select(key, order, "x.term", "x.cnt")
    known = terms_of.groupBy(key, "term").agg(F.count(F.lit(1)).alias("df"))
    ranked = terms_of.join(known.hint("merge"), [key, "term"]).groupBy(key, order).agg(F.sort_array(F.collect_list(F.struct("df", "term", "cnt"))).alias("x"))  # a title's terms
    square = lambda c: (c * c).cast("double")
    total = F.aggregate("x", F.lit(0.0), lambda acc, x: acc + square(x["cnt"]))
    start = F.struct(total.alias("left"), (total * SHARED_PART * (1 - 1e-9)).alias("least"), F.array().cast("array<string>").alias("p"))
    fold = F.aggregate("x", start, lambda acc, x: F.struct((acc["left"] - square(x["cnt"])).alias("left"), acc["least"].alias("least"),
                       F.when(acc["left"] > acc["least"], F.array_append(acc["p"], x["term"])).otherwise(acc["p"]).alias("p")), lambda acc: acc["p"])
    return titles.join(ranked.select(key, order, fold.alias("_p")).hint("merge"), [key, order])


def similar_titles(titles: DataFrame, key: str, order: str) -> DataFrame:
    """``key, a, b``: pairs of a search's titles (``a`` before ``b``) where ``b`` is more than 0.8
    relevant to ``a``; ``titles`` has ``_t``, the terms.

    A prefix-filtered join: titles meet only at a term that is the first they share in the order
    of rarity, and must be in both prefixes; candidates are verified by the score itself. (A cosine bounds no lengths: a
    title of any length may be close to a short one that it repeats.) Titles without terms (stop words, single characters) score by
    words found inside the other title: they meet at a word of the first that must be found and the parts of words of the second.
    """
    above = score(F.col("ta"), F.col("tb")) > rules.DUPLICATE_ABOVE
    p = _prefixes(titles.where(F.size("_t.uniq") > 0), key, order)
    side = lambda x: p.select(key, F.explode("_p").alias("_term"), F.col(order).alias(x), F.col("_p").alias("p" + x), F.col("_t").alias("t" + x))
    # Titles that repeat no term (most): the cosine follows from three sizes, and few candidates go on to the score.
    na, nb, both = F.size("ta.uniq"), F.size("tb.uniq"), F.size(F.array_intersect("ta.uniq", "tb.uniq"))
    once = (na == F.size("ta.grams")) & (nb == F.size("tb.grams"))
    close = both * both > (_COS - 1e-9) ** 2 * (both + (na - both) * IDF_ONE_SIDE_SQ) * (both + (nb - both) * IDF_ONE_SIDE_SQ)
    with_terms = side("a").join(side("b").hint("merge"), [key, "_term"]).where(
        (F.col("a") < F.col("b")) & (F.get(F.array_intersect("pa", "pb"), F.lit(0)) == F.col("_term")) & (~once | close) & above)
    bare = titles.where((F.size("_t.uniq") == 0) & (F.size("_t.words") > 0))
    n = F.size("_t.words")
    must = F.array_distinct(F.slice(F.transform(F.sort_array(F.transform("_t.words", lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))), False), lambda x: x["w"]),
                                    1, F.ceil((n - n * rules.DUPLICATE_ABOVE) - 1e-9).cast("int")))
    inside = F.array_distinct(F.flatten(F.transform("_t.words", lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.transform(
        F.sequence(F.lit(1), F.length(w) - i + 1), lambda m: F.substring(w, i, m)))))))
    without = (bare.select(key, F.explode(must).alias("_term"), F.col(order).alias("a"), F.col("_t").alias("ta"))
               .join(bare.select(key, F.explode(inside).alias("_term"), F.col(order).alias("b"), F.col("_t").alias("tb")).hint("merge"), [key, "_term"])
               .where((F.col("a") < F.col("b")) & above))
    return with_terms.select(key, "a", "b").unionByName(without.select(key, "a", "b").distinct())


def dedupe_offers(ranked: DataFrame, key: str = "query_id", order: str = "rank",
                  keep: Sequence[str] = ("title",)) -> DataFrame:
    """Walk each search's offers in rank order; drop an offer whose title is
    more than 0.8 relevant to an already kept title (new title as text, kept
    title as query, both lower-cased).

    Equal titles fall to the first of them by an aggregate with map-side combine. The similar pairs of what is left
    are found by a join; the walk over them is settled in rounds: a title none of whose earlier similar titles is open is kept
    and drops its later ones. Each round is a written table, and there are as many as the longest
    chain of titles that wait for each other; no search's titles ever meet in one row. (A blank
    title is relevant to nothing, itself included: every one of them stays.)"""
    cols = [order, *[c for c in keep if c != order]]
    blank = F.when(pystrip(F.col("title")) == "", F.col(order)).alias("_blank")
    first = ranked.groupBy(key, "title", blank).agg(F.min(order).alias(order), *[
        F.min_by(c, order).alias(c) for c in keep if c not in (order, "title")])
    titles = stored(first.select(key, *cols, terms(F.lower(F.col("title"))).alias("_t")), "titles")
    links = stored(similar_titles(titles, key, order), "similar-titles")
    dropped = None
    while not links.isEmpty():
        waiting = links.select(key, F.col("b").alias("a")).distinct()
        gone = stored(links.join(waiting.hint("merge"), [key, "a"], "left_anti").select(key, "b").distinct(), "dropped-titles")
        links = stored(links.join(gone.hint("merge"), [key, "b"], "left_anti").join(gone.select(key, F.col("b").alias("a")).hint("merge"), [key, "a"], "left_anti"), "similar-titles")
        dropped = gone if dropped is None else dropped.unionByName(gone)
    kept = titles.select(key, *cols)
    return kept if dropped is None else kept.join(dropped.select(key, F.col("b").alias(order)).hint("merge"), [key, order], "left_anti")


def dedupe_signature(df: DataFrame, key: Sequence[str], order: Sequence[str],
                     title: str = "title", price: str = "price") -> DataFrame:
    """Exact signature ``lower(trim(title)) | lower(trim(price))``; the first
    row per signature wins; rows with neither title nor price are skipped.

    ``groupBy(signature).agg(min_by(...))`` -- partial aggregation on the map
    side, so a signature repeated across a third of the rows is still cheap.
    """
    t = F.lower(pystrip(F.coalesce(F.col(title), F.lit(""))))
    p = F.lower(pystrip(F.coalesce(F.col(price), F.lit(""))))
    sig = F.concat(t, F.lit("|"), p)
    d = df.filter((t != "") | (p != "")).withColumn("signature", sig)
    others = [c for c in df.columns if c not in key]
    packed = F.struct(*[F.col(c) for c in others])
    return (d.groupBy(*key, "signature").agg(F.min_by(packed, F.struct(*_cols(order))).alias("_r"))
            .select(*key, "signature", *[F.col(f"_r.{c}").alias(c) for c in others]))
