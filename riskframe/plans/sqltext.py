"""Pieces of reference SQL built from the fixed word lists."""

from __future__ import annotations


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(items) -> str:
    return "[" + ", ".join(quoted(i) for i in items) + "]"


def in_list(expr: str, items) -> str:
    return f"({expr} IN ({', '.join(quoted(i) for i in items)}))"


def has_any(expr: str, items) -> str:
    return f"len(list_filter({values(items)}, lambda zz: contains({expr}, zz))) > 0"


def hit_count(expr: str, items) -> str:
    return f"len(list_filter({values(items)}, lambda zz: contains({expr}, zz)))"


def hit_list(expr: str, items) -> str:
    return f"list_filter({values(items)}, lambda zz: contains({expr}, zz))"


def ends_any(expr: str, items) -> str:
    return f"len(list_filter({values(items)}, lambda zz: ends_with({expr}, zz))) > 0"


def starts_any(expr: str, items) -> str:
    return f"len(list_filter({values(items)}, lambda zz: starts_with({expr}, zz))) > 0"


def under(expr: str, domains) -> str:
    return f"({in_list(expr, domains)} OR {ends_any(expr, ['.' + d for d in domains])})"


def matches(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {quoted(pattern)})"


#: RE2 knows only ASCII word characters; this spells the Unicode boundary out.
EDGE_BEFORE = r"(?:^|[^\p{L}\p{N}_])"
EDGE_AFTER = r"(?:$|[^\p{L}\p{N}_])"


def unicode_edges(pattern: str) -> str:
    """Replace the leading and trailing ``\\b`` of a pattern by Unicode edges."""
    flags = ""
    if pattern.startswith("(?i)"):
        flags, pattern = "(?i)", pattern[4:]
    if pattern.startswith(r"\b"):
        pattern = EDGE_BEFORE + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + EDGE_AFTER
    return flags + pattern
