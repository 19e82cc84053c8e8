"""Price parsing and display as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

import functools
import sys
import unicodedata

from . import rules
from .regex import jre, search


@functools.lru_cache(maxsize=1)
def _digit_map() -> tuple[str, str]:
    """Every non-ASCII Unicode decimal digit and its ASCII value, built from the
    Unicode digit property (Python's ``float`` and ``\\d`` accept all of them)."""
    src, dst = [], []
    for cp in range(0x80, sys.maxunicode + 1):
        d = unicodedata.decimal(chr(cp), None)
        if d is not None:
            src.append(chr(cp))
            dst.append(str(d))
    return "".join(src), "".join(dst)


def ascii_digits(col: Column) -> Column:
    """Map any Unicode decimal digit to its ASCII digit (before a numeric cast)."""
    src, dst = _digit_map()
    return F.translate(col, src, dst)


def to_double(col: Column) -> Column:
    """``float(s)`` for digit strings in any script; NULL when it does not parse."""
    return ascii_digits(col).try_cast("double")


def numeric_price(col: Column) -> Column:
    """Text -> number: empty -> 0; drop ``₵$£€,``; first ``[\\d.]+``; unparsable -> 0."""
    cleaned = F.regexp_replace(col, F.lit("[₵$£€,]"), F.lit(""))
    first = F.nullif(F.regexp_extract(cleaned, jre(r"[\d.]+"), 0), F.lit(""))
    return F.coalesce(to_double(first), F.lit(0.0))


def currency_of(col: Column) -> Column:
    """First currency symbol present, in lookup order; '' when none."""
    out = F.lit("")
    for sym, code in reversed(rules.CURRENCY_SYMBOLS):
        out = F.when(F.coalesce(col.contains(sym), F.lit(False)), F.lit(code)).otherwise(out)
    return out


def amount_of(col: Column) -> Column:
    """First ``\\d+(,\\d{3})*(\\.\\d{2})?`` as a number, commas removed; else 0."""
    m = search(col, rules.AMOUNT_PATTERN, 1)
    return F.coalesce(to_double(F.replace(m, F.lit(","), F.lit(""))), F.lit(0.0))


def parse_price(col: Column) -> Column:
    """Price text -> struct(amount, currency)."""
    return F.struct(amount_of(col).alias("amount"), currency_of(col).alias("currency"))


def format_price_text(col: Column) -> Column:
    """Text price: ``₵ 1,234.50`` when it parses to a positive number, else as given."""
    n = numeric_price(col)
    return F.when(n > 0, F.concat(F.lit("₵ "), F.format_number(n, 2))).otherwise(col)


def format_price_number(col: Column, currency: Column) -> Column:
    """Number price: ``₵`` for GHS, ``$`` otherwise."""
    sym = F.when(currency == F.lit("GHS"), F.lit("₵ ")).otherwise(F.lit("$"))
    return F.concat(sym, F.format_number(col, 2))


def site_price_number(col: Column, site_key: str) -> Column:
    """Captured site price text -> double, 0 when it does not parse."""
    if site_key == "aliexpress":
        c = F.regexp_replace(F.regexp_replace(col, F.lit(r"(?Ud)[\$,\s]"), F.lit("")), F.lit("USD"), F.lit(""))
    elif site_key == "ebay":
        c = F.replace(F.regexp_replace(col, F.lit(r"(?Ud)[^\d.,]"), F.lit("")), F.lit(","), F.lit(""))
    else:
        c = F.regexp_replace(F.regexp_replace(col, F.lit(r"(?Ud)[₵,\s]"), F.lit("")), F.lit("GH"), F.lit(""))
    return F.coalesce(to_double(F.nullif(c, F.lit(""))), F.lit(0.0))


def number_text(x: Column) -> Column:
    """A double as Python and SQL engines print it: without an exponent from 1e-4 to 1e16
    (Java's text has one from 1e7 and below 1e-3)."""
    t = x.cast("string")
    plain = F.regexp_replace(t.cast("decimal(38,20)").cast("string"), F.lit(r"(\.\d*?)0+$"), F.lit("$1"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    a = F.abs(x)
    return F.when(t.contains("E") & (a >= 1e-4) & (a < 1e16), plain).otherwise(t)
