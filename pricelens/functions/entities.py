"""Rule-based entity recognition over text chunks and entities -> offer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .prices import parse_price
from .regex import find_all, found, jre, let, pystrip, search
from .titles import generic_title


def title_entities(text: Column) -> Column:
    """All title candidates, pattern by pattern, in match order (stripped)."""
    parts = [F.transform(find_all(text, p, 1, flags="im"), lambda w: pystrip(w))
             for p in rules.ENTITY_TITLE_PATTERNS]
    return F.concat(*parts)


def price_entities(text: Column) -> Column:
    parts = [F.transform(find_all(text, p, 1, flags="i"), lambda w: pystrip(w))
             for p in rules.ENTITY_PRICE_PATTERNS]
    return F.concat(*parts)


_ON, _OFF = "\x01", "\x02"


def spans(text: Column, pattern: str, flags: str) -> Column:
    """ARRAY<STRUCT<start, end>> of the whole matches of a pattern (code points, end exclusive).

    Each match is marked where it stands and the text is cut at the marks: a match starts after all that
    the parts before it hold. (Searching for a match's text could find it earlier, where the pattern does not match.)
    """
    marked = F.regexp_replace(F.translate(text, _ON + _OFF, "\x03\x03"), F.lit(jre(pattern, flags)), F.lit(f"{_ON}$0{_OFF}"))
    parts = F.transform(F.split(marked, _ON), lambda p: F.struct(
        F.length(F.translate(p, _OFF, "")).alias("all"), (F.instr(p, _OFF) - 1).alias("match")))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    fold = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), lambda acc, x: F.struct(
        (acc["at"] + x["all"]).alias("at"),
        F.when(x["match"] >= 0, F.array_append(acc["out"], F.struct(acc["at"].alias("start"), (acc["at"] + x["match"]).alias("end")))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    return fold


def entities(text: Column) -> Column:
    """ARRAY<STRUCT<entity_group, word, ordinal, score, start, end>>: titles then prices, pattern by
    pattern in match order; ``start`` and ``end`` are those of the whole match."""
    def group(name: str, score: float, patterns: list[str], flags: str) -> list[Column]:
        return [F.zip_with(find_all(text, p, 1, flags=flags), spans(text, p, flags), lambda w, s: F.struct(
            F.lit(name).alias("entity_group"), pystrip(w).alias("word"), F.lit(score).alias("score"), s["start"].alias("start"), s["end"].alias("end"))) for p in patterns]
    every = F.concat(*group("TITLE", rules.ENTITY_TITLE_SCORE, rules.ENTITY_TITLE_PATTERNS, "im"),
                     *group("PRICE", rules.ENTITY_PRICE_SCORE, rules.ENTITY_PRICE_PATTERNS, "i"))
    return F.transform(every, lambda e, i: F.struct(
        e["entity_group"].alias("entity_group"), e["word"].alias("word"), i.alias("ordinal"), e["score"].alias("score"), e["start"].alias("start"), e["end"].alias("end")))


def longest(words: Column) -> Column:
    """Longest string of an array, the first one on a tie; NULL for an empty array."""
    return let(words, lambda w: F.when(F.size(w) > 0, F.aggregate(
        w, F.get(w, 0), lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))))


def title_fallback(text: Column) -> Column:
    """First line with 10 < length < 100 that does not look like a price or navigation."""
    lines = F.transform(F.split(text, "\n"), lambda ln: pystrip(ln))
    ok = F.filter(lines, lambda ln: (F.length(ln) > 10) & (F.length(ln) < 100)
                  & ~found(ln, rules.TITLE_FALLBACK_REJECT, flags="i"))
    return F.coalesce(generic_title(F.get(ok, 0)), F.lit(""))


def price_fallback(text: Column) -> Column:
    """struct(amount, currency) from the first fallback price pattern that matches."""
    m = F.coalesce(*[search(text, p, 1) for p in rules.PRICE_FALLBACK_PATTERNS])
    return F.when(m.isNotNull(), parse_price(m)).otherwise(
        F.struct(F.lit(0.0).alias("amount"), F.lit("").alias("currency")))


def description(text: Column, n: int | None = None) -> Column:
    """The whole text (with ``n``, its first characters and an ellipsis)."""
    if n is None:
        return text
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def entity_offer(text: Column) -> Column:
    """Entities -> struct(title, price, currency, description), with the fallbacks."""
    t = longest(title_entities(text))
    title = F.coalesce(F.nullif(generic_title(t), F.lit("")), title_fallback(text))
    first_price = F.get(price_entities(text), 0)  # all price entities score the same: first wins
    fb = price_fallback(text)

    def pick(pp: Column) -> Column:
        has = pp["amount"] != 0
        return F.struct(F.when(has, pp["amount"]).otherwise(fb["amount"]).alias("price"),
                        F.when(has, pp["currency"]).otherwise(fb["currency"]).alias("currency"))

    # parse the first price entity once; without one, the fallback decides
    pp = F.when(first_price.isNotNull(), parse_price(first_price))

    def build(v: Column) -> Column:
        pr = F.when(v.isNotNull(), pick(v)).otherwise(
            F.struct(fb["amount"].alias("price"), fb["currency"].alias("currency")))
        return F.struct(title.alias("title"), pr["price"].alias("price"), pr["currency"].alias("currency"),
                        description(text).alias("description"))
    return let(pp, build)
