"""Query/text relevance as one Column expression.

The score is ``min(1, cosine + 0.3 * share of query words found in the text)``
where cosine compares TF-IDF vectors fitted on just the two strings. With a
two-document corpus the smoothed idf only takes two values -- 1 for terms in
both, 1 + ln(1.5) for terms in one -- so no model is fitted: token counts,
n-grams and norms are array expressions evaluated per row in the JVM.

Tokens: lower-cased ``\\b\\w\\w+\\b`` minus the English stop list; terms are 1- to
3-grams of the remaining tokens. When neither side has a term, the score is the
share of query words found in the text (no 0.3 factor); 0 for an empty query.
Scores are rounded to 12 decimals so threshold tests are stable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .regex import let

# Fixed value: idf of a term present in only one of the two documents, 1 + ln(3/2).
IDF_ONE_SIDE = 1.4054651081081644
IDF_ONE_SIDE_SQ = IDF_ONE_SIDE * IDF_ONE_SIDE
TOKEN_PATTERN = r"(?U)\b\w\w+\b"
ROUND = 12


# The English stop words that Spark's StopWordsRemover documents as its default list.
STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll
we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split())


def stop_words() -> tuple[str, ...]:
    return STOP_WORDS


def tokens(text: Column) -> Column:
    t = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    stop = stop_words()
    return F.filter(t, lambda w: ~w.isin(*stop))  # IN over literals is planned as a hash-set lookup


def ngrams(toks: Column) -> Column:
    """1-, 2- and 3-grams (space-joined) of a token array (pass a column reference)."""
    n = F.size(toks)
    bi = F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2),
                                    lambda i: F.concat_ws(" ", F.get(toks, i), F.get(toks, i + 1))))
    tri = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3),
                                     lambda i: F.concat_ws(" ", F.get(toks, i), F.get(toks, i + 1), F.get(toks, i + 2))))
    empty = F.array().cast("array<string>")
    return F.concat(toks, F.coalesce(bi, empty), F.coalesce(tri, empty))


def terms(text: Column) -> Column:
    """struct(grams, words, low): everything the score needs from one side.

    Materialise it as a column (``with_relevance`` does) so the tokenizer runs
    once per value rather than once per use inside the score's lambdas.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.array_remove(F.split(low, r"(?U)\s+"), "")
    # the token array is referenced ~10 times by ngrams and the gram array by the counts:
    # bind each once; the struct is the let's result (extracting fields from a let would re-run it)
    grams = let(tokens(low), ngrams)
    def build(g: Column) -> Column:
        uniq = F.array_distinct(g)
        # short texts rarely repeat a term: then every count is 1 and no per-term scan is needed
        cnt = F.when(F.size(uniq) == F.size(g), F.array_repeat(F.lit(1), F.size(g))).otherwise(
            F.transform(uniq, lambda t: F.size(F.filter(g, lambda x: x == t))))
        return F.struct(g.alias("grams"), uniq.alias("uniq"), cnt.alias("cnt"), words.alias("words"),
                        low.alias("low"))
    return let(grams, build)


def _count(arr: Column, t: Column) -> Column:
    return F.size(F.filter(arr, lambda x: x == t))


def score(q: Column, d: Column) -> Column:
    """Relevance from two ``terms`` structs (query side, text side).

    Each side carries its distinct terms and their counts; the other side's count
    of a term is found by position (0 when absent). Sums run over the distinct
    terms in first-occurrence order.
    """
    def other_count(side: Column, t: Column) -> Column:
        i = F.array_position(side["uniq"], t)
        return F.when(i > 0, F.get(side["cnt"], (i - 1).cast("int"))).otherwise(F.lit(0))

    def weight(c: Column, present: Column) -> Column:
        return c.cast("double") * F.when(present, F.lit(1.0)).otherwise(F.lit(IDF_ONE_SIDE))

    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)

    # general case: per-term contributions (zip_with), summed in first-occurrence order
    g_dot = total(F.zip_with(q["uniq"], q["cnt"], lambda t, c: (c * other_count(d, t)).cast("double")))
    g_nq = total(F.zip_with(q["uniq"], q["cnt"], lambda t, c: weight(c, F.array_contains(d["uniq"], t))
                            * weight(c, F.array_contains(d["uniq"], t))))
    g_nd = total(F.zip_with(d["uniq"], d["cnt"], lambda t, c: weight(c, F.array_contains(q["uniq"], t))
                            * weight(c, F.array_contains(q["uniq"], t))))
    # no repeated term on either side (the usual case): every count is 1 and the sums reduce to set
    # sizes -- native array functions, no per-element lambdas
    nqu, ndu = F.size(q["uniq"]), F.size(d["uniq"])
    shared = F.size(F.array_intersect(q["uniq"], d["uniq"]))
    fast = (nqu == F.size(q["grams"])) & (ndu == F.size(d["grams"]))
    dot = F.when(fast, shared.cast("double")).otherwise(g_dot)
    nq = F.when(fast, (nqu - shared).cast("double") * F.lit(IDF_ONE_SIDE_SQ) + shared.cast("double")).otherwise(g_nq)
    nd = F.when(fast, (ndu - shared).cast("double") * F.lit(IDF_ONE_SIDE_SQ) + shared.cast("double")).otherwise(g_nd)
    cos = F.when((nq > 0) & (nd > 0), F.try_divide(dot, F.sqrt(nq) * F.sqrt(nd))).otherwise(F.lit(0.0))
    nw = F.size(q["words"])
    hits = F.size(F.filter(q["words"], lambda x: d["low"].contains(x)))
    share = F.when(nw > 0, F.try_divide(hits.cast("double"), nw.cast("double"))).otherwise(F.lit(0.0))
    out = (F.when((F.size(q["grams"]) == 0) & (F.size(d["grams"]) == 0), share)
           .when(nw == 0, F.lit(0.0))
           .otherwise(F.least(cos + share * rules.WORD_BOOST, F.lit(1.0))))
    return F.round(out, ROUND)


def relevance(text: Column, query: Column) -> Column:
    """R1/R2 relevance of ``text`` to ``query`` in [0, 1]; each side is tokenized once per row."""
    both = F.struct(terms(query).alias("q"), terms(text).alias("d"))
    return let(both, lambda p: score(p["q"], p["d"]))


def with_relevance(df, text: Column | str, query: Column | str, out: str):
    """Add ``out`` = relevance(text, query), tokenizing each side once."""
    t = F.col(text) if isinstance(text, str) else text
    q = F.col(query) if isinstance(query, str) else query
    return df.withColumn(out, relevance(t, q))


# ---------------------------------------------------------------- SQL spelling (oracle)
def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


STOP_CTE = f"stopw AS (SELECT {_sql_list(stop_words())} AS _stop)"


def grams_sql(t: str) -> str:
    return (f"list_concat({t}, CASE WHEN len({t}) >= 2 THEN list_transform(range(1, len({t})), "
            f"lambda i: {t}[i] || ' ' || {t}[i + 1]) ELSE []::VARCHAR[] END, "
            f"CASE WHEN len({t}) >= 3 THEN list_transform(range(1, len({t}) - 1), "
            f"lambda i: {t}[i] || ' ' || {t}[i + 1] || ' ' || {t}[i + 2]) ELSE []::VARCHAR[] END)")


def score_sql(q: str, d: str) -> str:
    """SQL relevance from two terms structs (column references): the general formula, term by term."""
    qg, dg = f"{q}.grams", f"{d}.grams"

    def cnt(arr, t):
        return f"len(list_filter({arr}, lambda _e: _e = {t}))"

    def w(own, other, t):
        return f"({cnt(own, t)}::DOUBLE * CASE WHEN list_contains({other}, {t}) THEN 1.0 ELSE {IDF_ONE_SIDE} END)"

    def total(arr, body):
        return (f"list_reduce(list_transform(list_distinct({arr}), lambda _g: {body}), "
                f"lambda _a, _b: _a + _b, 0.0::DOUBLE)")

    dot = total(qg, f"({cnt(qg, '_g')} * {cnt(dg, '_g')})::DOUBLE")
    nq = total(qg, f"{w(qg, dg, '_g')} * {w(qg, dg, '_g')}")
    nd = total(dg, f"{w(dg, qg, '_g')} * {w(dg, qg, '_g')}")
    cos = f"CASE WHEN {nq} > 0 AND {nd} > 0 THEN {dot} / (sqrt({nq}) * sqrt({nd})) ELSE 0.0 END"
    nw = f"len({q}.words)"
    share = (f"CASE WHEN {nw} > 0 THEN len(list_filter({q}.words, lambda _w: contains({d}.low, _w)))::DOUBLE / {nw} "
             f"ELSE 0.0 END")
    return (f"round(CASE WHEN len({qg}) = 0 AND len({dg}) = 0 THEN {share} WHEN {nw} = 0 THEN 0.0 "
            f"ELSE least({cos} + {share} * {rules.WORD_BOOST}, 1.0) END, {ROUND})")


def terms_select(src: str, cols: dict[str, str]) -> str:
    """``SELECT *, <terms struct of expr> AS name, ... FROM src`` (stop list joined in from ``stopw``)."""
    tok = ", ".join(
        f"list_filter(regexp_extract_all(lower(coalesce({e}, '')), '\\b\\w\\w+\\b', 0), "
        f"lambda w: NOT list_contains(_stop, w)) AS {n}__tok, "
        f"list_filter(string_split_regex(lower(coalesce({e}, '')), '\\s+'), lambda w: length(w) > 0) AS {n}__words, "
        f"lower(coalesce({e}, '')) AS {n}__low" for n, e in cols.items())
    packs = ", ".join(f"struct_pack(grams := {grams_sql(n + '__tok')}, words := {n}__words, low := {n}__low) AS {n}"
                      for n in cols)
    return f"SELECT *, {packs} FROM (SELECT *, {tok} FROM ({src}) s0, stopw) s1"
