"""Scalar helpers with the loose string/number semantics the catalog rules rely on.

The rules were written for a dynamically typed language, so "number" means "text that looks like
a number", blank text counts as zero where a rule says so, and a zero falls through an *or*
chain.  None of these helpers raises under ANSI mode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters treated as whitespace when trimming.
WHITESPACE = (
    " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
FLOAT_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
INT_PREFIX = r"^\s*([+-]?\d+)"


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def strip(c: Column) -> Column:
    """Trim every kind of whitespace (Spark's ``trim`` only removes spaces)."""
    return F.btrim(c, F.lit(WHITESPACE))


def to_number(c: Column) -> Column:
    """Whole-text number: blank is 0, anything that is not a plain decimal is null."""
    s = strip(c)
    return F.when(s == "", F.lit(0.0)).when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def int_prefix(c: Column) -> Column:
    """Leading integer of a text ("12 ft." is 12), null when there is none."""
    return F.nullif(F.regexp_extract(c, INT_PREFIX, 1), F.lit("")).try_cast("bigint")


def float_prefix(c: Column) -> Column:
    """Leading decimal of a text ("1.5 m" is 1.5), null when there is none."""
    return F.nullif(F.regexp_extract(c, FLOAT_PREFIX, 1), F.lit("")).try_cast("double")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_text(*cols: Column) -> Column:
    """First non-empty text; the last argument is returned as is when all others are empty."""
    *head, last = cols
    return F.coalesce(*[blank_to_null(c) for c in head], last)


def first_nonzero(*cols: Column) -> Column:
    """First non-zero number; the last argument is returned as is when all others are zero."""
    *head, last = cols
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in head], last)


def number_or(c: Column, default: float) -> Column:
    """Number of a text, with *default* for text that is not a number and for zero."""
    return F.coalesce(F.nullif(to_number(c), F.lit(0.0)), F.lit(float(default)))


def classify(c: Column, table: list[tuple[str, str]], default: str) -> Column:
    """Ordered substring tests on the lower-cased text; first hit wins."""
    low = F.lower(c)
    expr = None
    for needle, label in table:
        cond = low.contains(needle)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return F.coalesce(expr.otherwise(default), F.lit(default))


def lookup(c: Column, table: dict[str, str], default: Column | str | None) -> Column:
    """Exact lookup in a literal map, *default* on a miss."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), c)
    if default is None:
        return hit
    return F.coalesce(hit, default if isinstance(default, Column) else F.lit(default))


def split_list(c: Column, separators: str = "[,;]") -> Column:
    """Split a text list, trim the items and drop blank ones; null or blank text is an empty list."""
    return F.filter(
        F.transform(F.split(F.coalesce(c, F.lit("")), separators), strip), lambda x: x != ""
    )


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with *value* evaluated once, however often *fn* refers to it.

    Lambda bodies are not searched for common subexpressions, so an intermediate result that is
    used several times in one is bound to a lambda variable.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def any_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a & b, conds)


def compact(*items: Column) -> Column:
    """Array of the non-null items, in order."""
    return F.array_compact(F.array(*items))


def collapse_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def round_half_up(c: Column) -> Column:
    """Nearest integer with halves rounded towards positive infinity."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def title_case(c: Column) -> Column:
    """Separators to spaces, lower case, first letter of each word upper case."""
    spaced = strip(F.regexp_replace(F.regexp_replace(c, "[-_]+", " "), r"\s+", " "))
    return F.initcap(spaced)
