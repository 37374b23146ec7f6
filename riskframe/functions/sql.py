"""Temporary SQL functions for analysts.

Each is a plain SQL expression, so Catalyst in-lines and optimises it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

def _bind(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def _v4_number(v: str) -> str:
    part = lambda i: f"CAST(split_part({v}, '.', {i}) AS BIGINT)"
    return f"((({part(1)} * 256 + {part(2)}) * 256 + {part(3)}) * 256 + {part(4)})"


def _ip_class_sql() -> str:
    """The rule of ``headers.ip_class`` from the same tables of networks, for IPv4 and IPv6."""
    from riskframe import lexicons as lx
    from riskframe.functions.headers import IPV6_CLASSES, IPV6_SHAPE, STRICT_IPV4, _cidr

    strict = _quoted(STRICT_IPV4)
    cases = []
    for name, networks in lx.IPV4_CLASSES:
        tests = " OR ".join(f"n BETWEEN {a} AND {b}" for a, b in map(_cidr, networks))
        cases.append(f"WHEN {tests} THEN '{name}'")
    number_class = lambda number: _bind("n", number, f"CASE WHEN n IS NULL THEN 'INVALID' {' '.join(cases)} ELSE 'PUBLIC' END")

    groups = lambda x: f"filter(split({x}, ':'), g -> g <> '')"
    number = _v4_number("tail")
    plain = _bind("tail", _quoted_extract("low", r":(\d+\.\d+\.\d+\.\d+)$"), (
        f"CASE WHEN tail = '' THEN low WHEN tail RLIKE {strict} THEN concat(substring(low, 1, length(low) - length(tail)), "
        f"lower(hex(CAST(floor({number} / 65536) AS BIGINT))), ':', lower(hex({number} % 65536))) END"))
    filled = (
        "CASE WHEN (size(halves) = 2 AND size(s.l) + size(s.r) <= 7) OR (size(halves) = 1 AND size(s.l) = 8) THEN array_join(transform(concat("
        "s.l, array_repeat('0', greatest(8 - size(s.l) - size(s.r), 0)), s.r), g -> lpad(g, 4, '0')), '') END")
    digits = _bind("base", plain, _bind("halves", f"CASE WHEN base RLIKE {_quoted(IPV6_SHAPE)} THEN split(base, '::', -1) END", _bind(
        "s", f"named_struct('l', {groups('halves[0]')}, 'r', CASE WHEN size(halves) = 2 THEN {groups('get(halves, 1)')} ELSE array() END)", filled)))
    inner = number_class("CAST(conv(substring(d, 25, 8), 16, 10) AS BIGINT)")
    mapped = _bind("m", inner, "CASE WHEN m = 'LOOPBACK' THEN m WHEN m IN ('LINK_LOCAL', 'PRIVATE') THEN 'PRIVATE' ELSE 'RESERVED' END")
    v6 = _bind("d", digits, f"CASE WHEN d IS NULL THEN 'INVALID' WHEN d RLIKE '^0{{20}}ffff' THEN {mapped} " + " ".join(
        f"WHEN d RLIKE {_quoted(pattern)} THEN '{name}'" for name, pattern in IPV6_CLASSES) + " ELSE 'PUBLIC' END")
    v4 = number_class(f"CASE WHEN low RLIKE {strict} THEN {_v4_number('low')} END")
    return _bind("low", "lower(trim(coalesce(v, '')))", f"CASE WHEN contains(low, ':') THEN {v6} ELSE {v4} END")


def _quoted_extract(value: str, pattern: str) -> str:
    return f"regexp_extract({value}, {_quoted(pattern)}, 1)"


FUNCTIONS = {
    "redact_pii": ("v STRING", "STRING", (
        r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(v, ''), "
        r"'\\b([A-Za-z0-9._%+-]{1})[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\\.[A-Za-z]{2,})\\b', '$1***@$2'), "
        r"'\\b(?:\\+\\d{1,3}[\\s.-]?)?\\(?\\d{3}\\)?[\\s.-]?\\d{3}[\\s.-]?\\d{4}\\b', '[REDACTED_PHONE]'), "
        r"'\\b\\d{4}[- ]?\\d{4}[- ]?\\d{4}[- ]?\\d{4}\\b', '[REDACTED_CARD]'), "
        r"'\\b\\d{3}-\\d{2}-\\d{4}\\b', '[REDACTED_SSN]')")),
    "mask_email": ("v STRING", "STRING", (
        "CASE WHEN contains(v, '@') THEN concat(CASE WHEN length(split_part(v, '@', 1)) > 1 "
        "THEN concat(left(v, 1), '***') ELSE '***' END, '@', split_part(v, '@', 2)) ELSE v END")),
    "url_entropy": ("v STRING", "DOUBLE", (
        "aggregate(array_distinct(filter(split(coalesce(v, ''), ''), c -> c != '')), CAST(0 AS DOUBLE), (a, c) -> a - "
        "((length(v) - length(replace(v, c, ''))) / length(v)) * log2((length(v) - length(replace(v, c, ''))) / length(v)))")),
    "auth_status": ("v STRING, protocol STRING", "STRING", (
        r"coalesce(nullif(replace(upper(regexp_extract(lower(coalesce(v, '')), concat(lower(protocol), "
        r"'\\s*=\\s*(pass|fail|softfail|neutral|none|temperror|permerror|bestguesspass)'), 1)), 'BESTGUESSPASS', 'PASS'), ''), 'UNKNOWN')")),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary functions and return their names."""
    bodies = dict(FUNCTIONS)
    bodies["ip_class"] = ("v STRING", "STRING", _ip_class_sql())
    for name, (args, returns, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    return sorted(bodies)
