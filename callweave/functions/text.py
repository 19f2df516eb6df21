"""Text, number and sentinel rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Words that mean "no value".
SENTINELS: tuple[str, ...] = ("none", "null", "n/a", "")
DISPLAY_SENTINELS: tuple[str, ...] = ("none", "null", "n/a")

_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Drop all Unicode white space at both ends; ``trim`` would drop blanks only."""
    return F.regexp_replace(col(c), _EDGE_SPACE, "")


def missing(c: Column | str) -> Column:
    """NULL or the empty text."""
    return col(c).isNull() | (col(c) == "")


def is_value(c: Column | str) -> Column:
    """Storage rule: neither missing, nor blank, nor a sentinel. Sentinels are compared without stripping."""
    c = col(c)
    return F.coalesce((strip(c) != "") & ~F.lower(c).isin(*SENTINELS), F.lit(False))


def gate(c: Column | str) -> Column:
    """Stage rule: not missing and not a sentinel. A blank text passes."""
    c = col(c)
    return F.coalesce(~F.lower(c).isin(*SENTINELS), F.lit(False))


def display(c: Column | str) -> Column:
    """Shown value: sentinels and missing values become the empty text."""
    c = col(c)
    return F.when(c.isNull() | F.lower(c).isin(*DISPLAY_SENTINELS), "").otherwise(c)


def long_enough(c: Column | str, n: int) -> Column:
    """At least ``n`` characters besides the white space at both ends; NULL is not."""
    return F.coalesce(F.length(strip(c)) >= n, F.lit(False))


def head(c: Column | str, n: int) -> Column:
    """The first ``n`` characters."""
    return F.substring(col(c), 1, n)


def number(c: Column | str) -> Column:
    """A money or score column as a double, NULL as 0."""
    return F.coalesce(col(c).cast("double"), F.lit(0.0))


def iso_date(c: Column | str) -> Column:
    """A date as ISO text, NULL kept."""
    return F.date_format(col(c), "yyyy-MM-dd")


def speaker(c: Column | str) -> Column:
    """``agent`` or ``caller``; whatever else, or nothing, is a caller."""
    low = F.lower(col(c))
    return F.when(low.isin("agent", "caller"), low).otherwise("caller")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def matches(c: Column | str, query: Column | str, mode: str = "literal", lower: bool = True) -> Column:
    """Substring test. ``literal`` takes the query as is; in ``like`` mode ``%`` and ``_`` are wildcards.

    A missing column never matches. In like mode a backslash in the query stands for itself: the pattern's
    escape sign is a control character that no typed query holds.
    """
    c, q = col(c), (F.lit(query) if isinstance(query, str) else query)
    if lower:
        c, q = F.lower(c), F.lower(q)
    if mode == "literal":
        hit = F.contains(c, q)
    elif mode == "like":
        hit = F.like(c, F.concat(F.lit("%"), q, F.lit("%")), F.lit("\x01"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.coalesce(hit, F.lit(False))


def digits(c: Column | str, country_code: str | None = None) -> Column:
    """All digits of a phone number. With ``country_code``, a number written as of that country (``+`` or ``00`` and the
    code) loses the code; numbers of other countries keep theirs."""
    c = col(c)
    if country_code is not None:
        c = F.regexp_replace(c, rf"^\s*(\+|00)\s*{country_code}(?=[^0-9]|[0-9])", "")
    only = F.regexp_replace(c, "[^0-9]", "")
    return F.when(only != "", only)
