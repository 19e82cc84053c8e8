"""Regex helpers: Column expressions with the semantics of Python's ``re``.

Python ``str`` patterns treat ``\\s \\d \\w`` as Unicode classes; Java does that
only under ``(?U)``. ``(?d)`` makes only ``\\n`` end a line. ``regexp_extract``
returns '' for no match, so callers wrap it in ``nullif`` when they need NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable.

    ``body`` may reference the variable many times; since it is a bound lambda
    variable, neither expression substitution by the optimizer (filter
    push-down, project collapsing) nor the HOFs inside ``body`` recompute it.

    Rule kept throughout the package: do not put a second ``let`` inside ``body``
    whose own body reads the outer variable (bind both values in one struct
    instead) -- that shape gave wrong results in one case on Spark 4.1.
    """
    return F.get(F.transform(F.array(value), body), 0)


def jre(pattern: str, flags: str = "") -> str:
    """Java spelling of a Python pattern: Unicode classes plus the given flags."""
    return f"(?Ud{flags})" + pattern


def search(col: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    """``re.search(p, s).group(g)`` or NULL when there is no match."""
    return F.nullif(F.regexp_extract(col, jre(pattern, flags), group), F.lit(""))


def found(col: Column, pattern: str, flags: str = "") -> Column:
    """``bool(re.search(p, s))``."""
    return col.rlike(jre(pattern, flags))


def matches_from_start(col: Column, pattern: str, flags: str = "") -> Column:
    """``bool(re.match(p, s))`` -- anchored at the start only."""
    p = pattern if pattern.startswith("^") else "^(?:" + pattern + ")"
    return col.rlike(jre(p, flags))


def find_all(col: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    """``re.findall`` for a one-group pattern (or whole match with ``group=0``)."""
    return F.regexp_extract_all(col, F.lit(jre(pattern, flags)), F.lit(group))


def sub(col: Column, pattern: str, repl: str = "", flags: str = "") -> Column:
    """``re.sub(p, repl, s)`` (all occurrences)."""
    return F.regexp_replace(col, F.lit(jre(pattern, flags)), F.lit(repl))


def pystrip(col: Column) -> Column:
    """``str.strip()``: trims Unicode whitespace, not only spaces."""
    return F.regexp_replace(col, F.lit(r"(?Ud)^\s+|\s+$"), F.lit(""))


def collapse_ws(col: Column) -> Column:
    """``re.sub(r'\\s+', ' ', s).strip()``."""
    return pystrip(F.regexp_replace(col, F.lit(r"(?Ud)\s+"), F.lit(" ")))


def word_count(col: Column) -> Column:
    """``len(s.split())``."""
    return F.size(F.array_remove(F.split(col, r"(?Ud)\s+"), ""))


# ---- SQL (DuckDB / RE2) spelling of the same patterns, for the oracle ----

def sql_str(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_re(pattern: str, flags: str = "") -> str:
    """RE2 pattern literal. RE2 has no (?U) (it means *ungreedy* there)."""
    return sql_str((f"(?{flags})" if flags else "") + pattern)
