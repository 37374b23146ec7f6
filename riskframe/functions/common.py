"""Small column helpers shared by every rule module."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """The column as a string, with NULL read as empty."""
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Keeps rule expressions small where a derived value (a host, a label) is
    tested again and again.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def alternation(terms: Iterable[str]) -> str:
    """A pattern that matches any of the literals."""
    return "(?:" + "|".join(re.escape(t) for t in terms) + ")"


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(c: Column, terms: Iterable[str]) -> Column:
    return any_of(c.contains(t) for t in terms)


def ends_with_any(c: Column, suffixes: Iterable[str]) -> Column:
    return any_of(c.endswith(s) for s in suffixes)


def hit_count(c: Column, terms: Iterable[str]) -> Column:
    """How many of the terms occur in the text (each counted once)."""
    return reduce(lambda a, b: a + b, (c.contains(t).cast("int") for t in terms), F.lit(0))


def hits(c: Column, terms: Iterable[str]) -> Column:
    """The terms that occur in the text, in list order."""
    return F.array_compact(F.array(*[F.when(c.contains(t), F.lit(t)) for t in terms]))


def occurrences(c: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    if len(term) == 1:
        return F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("int")


def all_occurrences(c: Column, terms: Iterable[str]) -> Column:
    return reduce(lambda a, b: a + b, (occurrences(c, t) for t in terms), F.lit(0))


def compact(*values: Column) -> Column:
    return F.array_compact(F.array(*values))


def clamp(c: Column, low: int | float = 0, high: int | float = 100) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def truncated(c: Column) -> Column:
    """Drop the fraction, as an integer cast does."""
    return c.cast("int")


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


#: What stands before the path: scheme, user information, and the host (group 1 in brackets, group 2 otherwise).
_AUTHORITY = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(?:\[([^\]/?#]*)\]|([^:/?#]*))"
_BEFORE_PATH = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?"


def raw_host_of(url: Column) -> Column:
    """Host of a URL as written; empty when there is none. Any character is taken, so an odd one cannot hide a host."""
    return F.coalesce(F.concat(F.regexp_extract(url, _AUTHORITY, 1), F.regexp_extract(url, _AUTHORITY, 2)), F.lit(""))


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL; empty when there is none."""
    return F.lower(raw_host_of(url))


def path_of(url: Column) -> Column:
    """Path of a URL; empty for schemes without one (``mailto:x``)."""
    opaque = url.rlike(r"^[\x00-\x20]*[A-Za-z][A-Za-z0-9+.\-]*:[^/]")
    return F.when(opaque, "").otherwise(F.coalesce(F.regexp_extract(url, _BEFORE_PATH + "([^?#]*)", 1), F.lit("")))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))
