"""Relevance, budgets, ranking and de-duplication queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.relevance import ROUND, STOP_CTE, score, score_sql, terms, terms_select
from ..operators import compare as C
from ..operators import ranking as RK
from ..sources import fixtures as fx
from ..sources.tables import load
from .registry import query

N = rules.GENERIC_RESULT_CAP   # 15 results per search
L = fx.LINE_ORDER_SQL
FXR = ["offers", "searches"]


def _description(title, source):
    return F.concat(F.lit("Buy "), title, F.lit(" from "), source)


def scored_texts(parts):
    """``p_name, title``, their scores: each distinct pair of a part's name and its title once.
    ``desc_rel`` has the five sites' descriptions, by ``site_ord``; the other two scores know no site.
    The scores leave a generator, so a filter on them is tested after it and does not evaluate them again."""
    spark = parts.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    t = parts.select("p_name", "title").distinct().repartition(n, "p_name", "title")  # by number: not put together again
    t = t.select("*", F.inline(F.array(F.struct(terms(F.col("p_name")).alias("tq"), terms(F.col("title")).alias("tt")))))
    k = t.select("*", F.inline(C.sites_array())).drop("search_prefix", "site_key")
    k = k.select("*", F.inline(F.array(F.struct(terms(_description(F.col("title"), F.col("source"))).alias("td")))))
    scores = F.struct(F.when(F.col("site_ord") == 0, score(F.col("tq"), F.col("tt"))).alias("title_rel"), score(F.col("tq"), F.col("td")).alias("desc_rel"),
                      F.when(F.col("site_ord") == 0, score(F.col("tt"), F.col("tq"))).alias("reverse_rel"))
    k = k.select("p_name", "title", "site_ord", F.inline(F.array(scores)))
    return k.groupBy("p_name", "title").agg(
        F.max("title_rel").alias("title_rel"), F.max("reverse_rel").alias("reverse_rel"),
        F.array(*[F.max(F.when(F.col("site_ord") == i, F.col("desc_rel"))) for i in range(len(rules.SITES))]).alias("desc_rel"))


def scored_offers(spark, sf_dir):
    """Every offer with its scores against its search. Scores depend on the part's texts and the site
    only, so they are computed on the distinct texts, joined to the parts and then to the offers.
    Both are joins of two shuffled sides: the size of parts in dictionary-coded files is taken for a
    small part of what it is, and would let them be broadcast, through the driver, at any number.
    The offers, many times as many as the parts, are not sorted for it: a task holds its share of the
    parts and reads its offers past them."""
    p = load(spark, sf_dir, "part").where("p_name IS NOT NULL").select(
        "p_partkey", "p_name", fx.offer_title(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("title"))
    k = p.join(scored_texts(p).hint("shuffle_hash"), ["p_name", "title"]).select(
        "p_partkey", fx.hash_id(F.col("p_name")).alias("query_id"), "title", "title_rel", "desc_rel", "reverse_rel")
    li = load(spark, sf_dir, "lineitem").select(*fx.LINE_ORDER, (F.col("l_suppkey") % 5).cast("int").alias("site_ord"))
    j = li.where("site_ord >= 0").join(k.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    of_site = lambda name: F.get(F.transform(C.sites_array(), lambda x: x[name]), F.col("site_ord"))
    return j.select(*fx.LINE_ORDER, "query_id", "title", "site_ord", of_site("site_key").alias("site_key"), of_site("source").alias("source"),
                    "title_rel", F.get("desc_rel", F.col("site_ord")).alias("desc_rel"), "reverse_rel")


def candidates_df(spark, sf_dir):
    """Generic-extractor candidates: every offer of a search, with the relevance gate of its
    text against the query."""
    gen = F.create_map(*[x for i, k in enumerate(rules.GENERIC_SITE_ORDER) for x in (F.lit(k), F.lit(i))])
    s = F.round(F.col("title_rel") * rules.RANK_TITLE_WEIGHT + F.col("desc_rel") * rules.RANK_DESC_WEIGHT, ROUND)
    return scored_offers(spark, sf_dir).withColumns({
        "gen_ord": F.try_element_at(gen, F.col("site_key")), "relevance_score": s, "price": F.col("l_extendedprice"),
        "valid": (F.col("desc_rel") >= rules.RELEVANCE_MIN) & (F.length("title") > 5) & (F.col("l_extendedprice") > 0)})


def top_df(spark, sf_dir):
    """Sites are visited in the generic extractor's order (``gen_ord``). No site can look past
    its first N offers, so only those are numbered (a map-side group limit)."""
    w = Window.partitionBy("query_id", "site_ord").orderBy(*fx.LINE_ORDER)
    first = (candidates_df(spark, sf_dir).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= N)
             .withColumn("pos", F.col("_rn") - 1).drop("_rn"))
    return RK.site_budget(first, N, site="gen_ord")


def ranked_df(spark, sf_dir):
    """Every valid offer of every search, ranked."""
    c = candidates_df(spark, sf_dir).filter("valid")
    return RK.number_by_score(c, tie=("gen_ord", *fx.LINE_ORDER))


_GEN_SQL = "CASE site_key " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(rules.GENERIC_SITE_ORDER)) + " END"
# Every distinct (search, title, source) scored by the general formula.
_PAIRS = "SELECT DISTINCT query_id, query, title, source, 'Buy ' || title || ' from ' || source AS description FROM offers"
SCORES_CTE = f"""scores AS MATERIALIZED (SELECT query_id, title, source, {score_sql('tq', 'tt')} AS title_rel, {score_sql('tq', 'td')} AS desc_rel,
  {score_sql('tt', 'tq')} AS reverse_rel FROM ({terms_select(_PAIRS, {'tq': 'query', 'tt': 'title', 'td': 'description'})}) t)"""
CAND_SQL = f"""SELECT *, {_GEN_SQL} AS gen_ord, (desc_rel >= {rules.RELEVANCE_MIN} AND length(title) > 5 AND price > 0) AS valid,
  round(title_rel * {rules.RANK_TITLE_WEIGHT} + desc_rel * {rules.RANK_DESC_WEIGHT}, {ROUND}) AS relevance_score
  FROM offers JOIN scores USING (query_id, title, source)"""


def _ctes() -> str:
    steps = [STOP_CTE, SCORES_CTE, f"cand AS MATERIALIZED ({CAND_SQL})",
             f"""first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, site_ord ORDER BY {L}) - 1 AS pos
      FROM cand) f WHERE pos < {N})""", f"b0 AS (SELECT query_id, {N} AS b0 FROM searches)"]
    for k in range(len(rules.SITES)):
        steps.append(
            f"b{k + 1} AS (SELECT p.*, greatest(p.b{k} - (SELECT count(*) FROM first v WHERE v.valid "
            f"AND v.query_id = p.query_id AND v.gen_ord = {k} AND v.pos < p.b{k}), 0) AS b{k + 1} FROM b{k} p)")
    case = "CASE v.gen_ord " + " ".join(f"WHEN {k} THEN bb.b{k}" for k in range(len(rules.SITES))) + " END"
    steps.append(f"top AS (SELECT v.* FROM first v JOIN b{len(rules.SITES)} bb USING (query_id) "
                 f"WHERE v.valid AND v.pos < {case})")
    steps.append(f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC,
      gen_ord, {L}) AS rank FROM cand WHERE valid)""")
    return "WITH " + ",\n".join(steps)


CTES = _ctes()


@query("relevance", sql=f"""WITH {STOP_CTE}, {SCORES_CTE}
  SELECT query_id, site_key, l_orderkey, l_linenumber, l_partkey, l_suppkey, title_rel, desc_rel, reverse_rel
  FROM offers JOIN scores USING (query_id, title, source)""", fixtures=FXR)
def relevance_q(spark, sf_dir):
    """Relevance of every offer's title and description to its search (and the reverse direction)."""
    return scored_offers(spark, sf_dir).select("query_id", "site_key", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                               "title_rel", "desc_rel", "reverse_rel")


@query("top_offers", sql=f"{CTES}\nSELECT query_id, site_key, pos, title, price FROM top", fixtures=FXR)
def top_offers(spark, sf_dir):
    """Generic extractor's budget across sites -- each site looks at as many chunks
    as the remaining budget; earlier sites fill first; 15 per search at most."""
    return top_df(spark, sf_dir).select("query_id", "site_key", "pos", "title", "price")  # noqa


@query("rank_offers", sql=f"{CTES}\nSELECT query_id, rank, site_key, l_orderkey, l_linenumber, relevance_score FROM ranked",
       fixtures=FXR)
def rank_offers(spark, sf_dir):
    """Offers ranked by 0.7 x title relevance + 0.3 x description relevance (stable)."""
    return ranked_df(spark, sf_dir).select("query_id", "rank", "site_key", "l_orderkey", "l_linenumber", "relevance_score")


# Equal titles fall to the first of them; what is left is walked in rank order.
_PACK_SRC = terms_select("SELECT query_id, min(rank) AS rank, title FROM ranked GROUP BY query_id, title, CASE WHEN trim(title) = '' THEN rank END", {"tt": "lower(title)"})
_DUP = (f"list_reduce(items, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: "
        f"{score_sql('k.t', 'x.t')} > {rules.DUPLICATE_ABOVE})) > 0 THEN acc ELSE list_append(acc, x) END, "
        f"[]::STRUCT(rank BIGINT, title VARCHAR, t STRUCT(grams VARCHAR[], words VARCHAR[], low VARCHAR))[])")


@query("dedupe_offers", sql=f"""{CTES},
  packed AS (SELECT query_id, list(struct_pack(rank := CAST(rank AS BIGINT), title := title, t := tt) ORDER BY rank)
             AS items FROM ({_PACK_SRC}) p GROUP BY query_id)
  SELECT query_id, k.rank AS rank, k.title AS title FROM (SELECT query_id, unnest({_DUP}) AS k FROM packed) d""",
       fixtures=FXR)
def dedupe_offers(spark, sf_dir):
    """Near-duplicate titles removed, walking each search's ranked list in order."""
    return RK.dedupe_offers(ranked_df(spark, sf_dir))


_SIG_T = "regexp_replace(title, '^\\s+|\\s+$', '', 'g')"


@query("dedupe_signature", sql=f"""SELECT query_id, signature, title, price_text FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, signature ORDER BY site_ord, {L}) AS rn FROM (
    SELECT query_id, site_ord, {L}, title, CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR) AS price_text,
      lower({_SIG_T}) || '|' || lower(CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR)) AS signature
    FROM offers) x) y WHERE rn = 1""", fixtures=FXR)
def dedupe_signature(spark, sf_dir):
    """Exact (title, price) signature de-duplication over all offers of a search, first row wins."""
    u = fx.offers(spark, sf_dir).withColumn("price_text", F.col("price").cast("decimal(18,2)").cast("string"))
    d = RK.dedupe_signature(u.select("query_id", "site_ord", *fx.LINE_ORDER, "title", "price_text"),
                            key=["query_id"], order=["site_ord", *fx.LINE_ORDER], price="price_text")
    return d.select("query_id", "signature", "title", "price_text")
