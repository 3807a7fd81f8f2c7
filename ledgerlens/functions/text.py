"""Shared string helpers as Spark column expressions (JVM-side, codegen friendly).

Python ``str.strip()`` removes every Unicode whitespace character while Spark's
``trim`` removes spaces only, so text that must follow Python semantics goes
through :func:`strip_ws`.  Regexes that must agree with Python's ``re`` carry the
flag prefixes described in the README (``d`` = only ``\\n`` ends a line, ``U`` =
Unicode classes).
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.isspace() sees it: Unicode White_Space plus the
# information separators U+001C..U+001F.
_WS = r"[\s\x1c-\x1f]"
_STRIP_RE = rf"(?U)\A{_WS}+|{_WS}+\z"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(col(c), _STRIP_RE, "")


def lstrip_ws(c) -> Column:
    return F.regexp_replace(col(c), rf"(?U)\A{_WS}+", "")


def is_blank(c) -> Column:
    """``not s or not s.strip()`` (null counts as blank); stops at the first non-space."""
    return ~F.coalesce(col(c).rlike(rf"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def non_empty(c) -> Column:
    """Python truthiness of an optional string: present and non-empty."""
    return F.coalesce(F.length(col(c)) > 0, F.lit(False))


def last_match(c, pattern: str, group: int = 1) -> Column:
    """Group ``group`` of the last non-overlapping match of ``pattern`` (null if none)."""
    return F.try_element_at(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group)), F.lit(-1))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def py_repr(c) -> Column:
    """Python ``repr()`` of a string for the printable subset (quotes, backslash, tab, CR, LF).

    Python picks double quotes when the text holds a single quote and no double quote.
    """
    s = col(c)
    esc = F.regexp_replace(s, r"\\", r"\\\\")
    esc = F.regexp_replace(esc, "\n", r"\\n")
    esc = F.regexp_replace(esc, "\r", r"\\r")
    esc = F.regexp_replace(esc, "\t", r"\\t")
    use_double = s.contains("'") & ~s.contains('"')
    return F.when(use_double, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.regexp_replace(esc, "'", r"\\'"), F.lit("'")))


def staged(df, **cols: Column):
    """Add ``cols`` to ``df`` so that each is evaluated exactly once per row.

    Catalyst inlines an aliased expression into every later reference, including a
    filter it pushes below the projection (and below a repartition).  For a regex
    cascade that doubles the most expensive work of a query and can move it into the
    few tasks of a scan.  A one-element ``inline`` is a Generate node: predicates on
    its outputs are not pushed below it and projections do not collapse through it.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
