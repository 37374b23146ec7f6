"""URL and domain rules: brand imitation, reputation, lexical features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.functions.common import (
    alternation, clamp, col, compact, contains_any, host_of, let, occurrences, path_of, query_of, raw_host_of, strip, text,
)

IPV4_HOST = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
ADDRESS_PATTERN = r"[\w.\-+]+@[\w.\-]+\.\w+"


def clean_domain(c: Column | str) -> Column:
    """Host name out of an address, a URL or plain text; empty when it is none."""
    target = F.lower(strip(text(c)))
    target = F.when(target.contains("@"), strip(F.btrim(F.substring_index(target, "@", -1), F.lit(">")))).otherwise(target)
    target = F.when(target.rlike("^https?://"), host_of(target)).otherwise(target)
    target = F.btrim(F.btrim(target, F.lit("/")), F.lit("<> "))
    return F.when(target.contains(".") & (F.length(target) >= 4), target).otherwise("")


def is_or_under(host: Column, domains: list[str]) -> Column:
    """Host equals one of the domains or lies below it."""
    return host.rlike(rf"(?:^|\.){alternation(domains)}$")


def is_trusted_host(host: Column) -> Column:
    return is_or_under(host, lx.TRUSTED_DOMAINS) | host.rlike(alternation(lx.INSTITUTION_SUFFIXES) + "$")


def is_trusted_mobile(host: Column) -> Column:
    return is_or_under(host, lx.MOBILE_TRUSTED_HOSTS)


def host_suffixes(host: Column) -> Column:
    """All dot suffixes of a host (for equi-joins against large trust lists)."""
    parts = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


# -- brand imitation -------------------------------------------------------

def brand_imitation(domain: Column | str, brands=None) -> Column:
    """First decisive brand in list order, as ``struct<brand, type>`` (NULL when clean).

    Official domain ends the search; a brand inside the root label is a
    COMBOSQUAT; edit distance one or two a TYPOSQUAT; a brand in the
    sub-domain a SUBDOMAIN_SPOOF.
    """
    kind_type = "struct<brand:string,type:string>"

    def split_host(name: Column) -> Column:
        parts = F.split(name, r"\.")
        n = F.size(parts)
        return F.struct(
            name.alias("name"), F.when(n >= 2, F.element_at(parts, -2)).alias("root"),
            F.when(n > 2, F.array_join(F.slice(parts, 1, n - 2), ".")).otherwise("").alias("sub"))

    def decide(h: Column) -> Column:
        decided = F.when(h["root"].isNull(), F.lit(None).cast(kind_type))
        for brand, official in brands or lx.PROTECTED_BRANDS:
            found = lambda kind: F.struct(F.lit(brand).alias("brand"), F.lit(kind).alias("type"))  # noqa: B023, E731
            decided = decided.when(is_or_under(h["name"], official), F.lit(None).cast(kind_type)).when(
                h["root"].contains(brand), found("COMBOSQUAT"))
            if len(brand) >= 4:
                near = F.levenshtein(h["root"], F.lit(brand), 2).between(1, 2)
                decided = decided.when((F.length(h["root"]) >= 4) & near, found("TYPOSQUAT"))
            decided = decided.when(
                (h["sub"] != "") & h["sub"].rlike(alternation([brand, *official])), found("SUBDOMAIN_SPOOF"))
        return decided

    return let(let(F.lower(strip(text(domain))), split_host), decide)


# -- mobile domain check ---------------------------------------------------

def registrable(host: Column) -> Column:
    """``struct<root, prefix>``: registrable domain and what stands before it."""
    def cut(parts: Column) -> Column:
        n = F.size(parts)
        keep = F.when((n >= 3) & F.array_join(F.slice(parts, -2, 2), ".").isin(lx.TWO_LEVEL_SUFFIXES), 3).otherwise(2)
        head = F.greatest(n - keep, F.lit(0))
        return F.struct(
            F.when(n <= 2, F.array_join(parts, ".")).otherwise(F.array_join(F.slice(parts, head + 1, keep), ".")).alias("root"),
            F.when(n <= 2, "").otherwise(F.array_join(F.slice(parts, 1, head), ".")).alias("prefix"))

    return let(F.split(F.lower(host), r"\."), cut)


def mixed_scripts(label: Column) -> Column:
    return label.rlike(r"\p{IsLatin}") & label.rlike(r"[\p{IsCyrillic}\p{IsGreek}\p{IsArabic}]")


def fold_homoglyphs(c: Column) -> Column:
    return F.translate(c, "".join(a for a, _ in lx.HOMOGLYPHS), "".join(b for _, b in lx.HOMOGLYPHS))


def domain_spoof(host: Column, unicode_host: Column | None = None) -> Column:
    """``struct<typosquat, homograph>`` for a host.

    ``unicode_host`` is the punycode-decoded form where the host is an IDN
    (see ``operators.enrichment.decode_hosts``).
    """
    raw = F.lower(strip(text(host)))
    shown = F.lower(F.coalesce(unicode_host, raw)) if unicode_host is not None else raw
    brands = F.array(*[F.lit(b) for b in lx.MOBILE_BRANDS])

    def judge(h: Column) -> Column:
        label = F.substring_index(h["folded"]["root"], ".", 1)
        live = (h["raw"] != "") & ~h["root"].isin(lx.OFFICIAL_ROOTS)

        def tests(name: Column) -> Column:
            long = F.length(name) >= 4
            near = long & F.exists(brands, lambda b: (F.length(b) >= 4) & (name != b) & F.levenshtein(name, b, 2).between(1, 2))
            same = F.exists(brands, lambda b: (name == b) | (long & (F.levenshtein(name, b, 2) >= 0)))
            return F.struct(near.alias("near"), same.alias("same"))

        def verdict(t: Column) -> Column:
            prefix = h["folded"]["prefix"]
            in_prefix = (prefix != "") & prefix.rlike(alternation(lx.MOBILE_BRANDS))
            mixed = F.exists(F.split(h["shown"], r"\."), mixed_scripts)
            imitated = (h["raw"].startswith("xn--") | (h["folded"]["root"] != h["root"]) | mixed) & t["same"]
            return F.struct((live & (t["near"] | in_prefix)).alias("typosquat"), (live & (mixed | imitated)).alias("homograph"))

        return let(let(label, tests), verdict)

    facts = F.struct(
        raw.alias("raw"), shown.alias("shown"), registrable(shown)["root"].alias("root"),
        registrable(fold_homoglyphs(shown)).alias("folded"))
    return let(facts, judge)


# -- URL reputation --------------------------------------------------------

def url_scheme(url: Column) -> Column:
    """Text before the first colon, lower-cased, also where a URL has no host."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_assessment(url: Column | str) -> Column:
    """Host flags and risk of one URL as a struct."""
    value = text(url)
    return host_assessment(host_of(value), url_scheme(value))


def host_assessment(host: Column, scheme: Column) -> Column:
    """The same for a host under a scheme: all that a URL's rating depends on."""
    internal = rf"^(?:{'|'.join(h.replace('.', chr(92) + '.') for h in lx.INTERNAL_HOSTS)})$|^{alternation(lx.INTERNAL_PREFIXES)}"

    def flags(h: Column) -> Column:
        return F.struct(
            h["host"].alias("domain"), h["host"].isin(lx.SHORTENERS).alias("is_shortener"),
            is_trusted_host(h["host"]).alias("is_trusted"),
            h["host"].rlike(alternation(lx.SUSPICIOUS_TLDS) + "$").alias("suspicious_tld"),
            h["host"].rlike(IPV4_HOST).alias("ip_based"), h["host"].rlike(internal).alias("internal"),
            h["scheme"].isin(lx.DANGEROUS_SCHEMES).alias("dangerous"), brand_imitation(h["host"]).alias("outcome"))

    def rate(f: Column) -> Column:
        risk = (
            F.when(f["dangerous"], 95).when(f["outcome"].isNotNull(), 90).when(f["internal"] | f["ip_based"], 90)
            .when(f["is_shortener"] & f["suspicious_tld"], 85).when(f["is_shortener"], 75)
            .when(f["suspicious_tld"], 70).when(~f["is_trusted"], 25).otherwise(0))
        return F.struct(
            *[f[c].alias(c) for c in ("domain", "is_shortener", "is_trusted", "suspicious_tld", "ip_based")],
            f["outcome"].isNotNull().alias("is_brand_impersonation"), f["outcome"]["brand"].alias("brand"),
            f["outcome"]["type"].alias("impersonation_type"), risk.alias("risk_score"))

    return let(let(F.struct(host.alias("host"), scheme.alias("scheme")), flags), rate)


# -- spoofed senders -------------------------------------------------------

def address_domain(c: Column) -> Column:
    return F.substring_index(F.regexp_extract(F.lower(text(c)), ADDRESS_PATTERN, 0), "@", -1)


def spoof_check(sender: Column | str, reply_to: Column | str, return_path: Column | str) -> Column:
    """Display-name, free-mail, look-alike and header-mismatch evidence of a sender."""
    raw = text(sender)
    brands = F.array(*[F.lit(d.split(".")[0]) for d in lx.TRUSTED_DOMAINS])
    named = r'^"?(.+?)"?\s*<(.+?)>'
    facts = F.struct(
        address_domain(raw).alias("sent"), F.lower(F.regexp_extract(raw, named, 1)).alias("display"),
        F.lower(F.regexp_extract(raw, named, 2)).alias("mailbox"), address_domain(text(reply_to)).alias("reply"),
        address_domain(text(return_path)).alias("back"))

    def say(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def compare(m: Column) -> Column:
        domain = F.when(m["mailbox"].contains("@"), F.substring_index(m["mailbox"], "@", -1)).otherwise("")
        local = F.split_part(m["mailbox"], F.lit("@"), F.lit(1))
        folded = F.replace(F.replace(F.translate(m["sent"], "10", "lo"), F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))
        shown, none = m["display"] != "", F.array().cast("array<string>")
        claimed = F.when(shown, F.filter(brands, lambda b: m["display"].contains(b) & ~domain.contains(b))).otherwise(none)
        free = F.when(shown & domain.isin(lx.FREEMAIL_DOMAINS), F.filter(brands, lambda b: local.contains(b))).otherwise(none)
        alike = F.when(m["sent"] != "", F.filter(brands, lambda b: folded.contains(b) & ~m["sent"].contains(b))).otherwise(none)
        return F.struct(
            m.alias("m"), domain.alias("domain"), local.alias("local"), claimed.alias("claimed"), free.alias("free"),
            alike.alias("alike"), ((m["sent"] != "") & (m["reply"] != "") & (m["reply"] != m["sent"])).alias("reply_differs"),
            ((m["sent"] != "") & (m["back"] != "") & (m["back"] != m["sent"])).alias("back_differs"))

    def conclude(c: Column) -> Column:
        m, mismatch = c["m"], c["reply_differs"] | c["back_differs"]
        factors = F.concat(
            F.transform(c["claimed"], lambda b: say(
                "Display name mentions '", b, "' but email domain is '", c["domain"], "'")),
            F.transform(c["free"], lambda b: say(
                "Free-mail service '", c["domain"], "' impersonating corporate brand '", b, "' in username ('", c["local"], "')")),
            F.transform(c["alike"], lambda b: say(
                "Lookalike / typosquat domain detected: '", m["sent"], "' mimics legitimate brand '", b, "'")),
            compact(
                F.when(c["reply_differs"], say("Header mismatch: Reply-To domain (", m["reply"], ") differs from sender domain (", m["sent"], ")")),
                F.when(c["back_differs"], say("Header mismatch: Return-Path domain (", m["back"], ") differs from sender domain (", m["sent"], ")"))))
        some = lambda n: F.size(c[n]) > 0
        score = (
            F.when(some("alike"), 85).when(some("free"), 80).when(some("claimed"), 75).when(mismatch, 65).otherwise(0))
        return F.struct(
            score.alias("score"), mismatch.alias("header_mismatch"), some("alike").alias("lookalike"),
            (some("claimed") | some("free")).alias("impersonating"), some("claimed").alias("display_claim"),
            factors.alias("factors"))

    return let(let(facts, compare), conclude)


def display_spoof(sender: Column | str) -> Column:
    """First brand the display name claims while the mailbox does not carry it."""
    raw = text(sender)
    bracketed = raw.contains("<") & raw.contains(">")
    shown = F.lower(F.btrim(strip(F.substring_index(raw, "<", 1)), F.lit('"')))
    mailbox = F.lower(strip(F.regexp_extract(raw, r"<([^>]*)>", 1)))
    brands = F.array(*[F.lit(b) for b in lx.DISPLAY_NAME_BRANDS])
    return F.when(bracketed, let(F.struct(shown.alias("s"), mailbox.alias("m")), lambda x: F.get(
        F.filter(brands, lambda b: x["s"].contains(b) & ~x["m"].contains(b)), F.lit(0))))


# -- lexical features ------------------------------------------------------

def entropy_bits(c: Column) -> Column:
    """Shannon entropy of the characters of a string, in bits."""
    def total(value: Column) -> Column:
        n = F.length(value).cast("double")
        shares = F.transform(
            F.filter(F.array_distinct(F.split(value, "")), lambda ch: ch != ""),
            lambda ch: (n - F.length(F.replace(value, ch, F.lit("")))) / n)
        return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    return let(c, total)


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def lexical_features(url: Column | str) -> dict[str, Column]:
    """The 29 lexical URL features, by name, in fixed order."""
    u = text(url)
    domain, length = netloc(u), F.length(u)
    digits = F.regexp_count(u, F.lit(r"\p{Nd}"))
    letters = F.regexp_count(u, F.lit(r"\p{L}"))
    is_address = domain.rlike(rf"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    last_slashes = length - F.length(F.substring_index(u, "//", -1)) - 2
    bit = lambda c: c.cast("int")
    return {
        "url_length": length, "domain_length": F.length(domain), "path_length": F.length(url_path(u)),
        "count_dots": occurrences(u, "."), "count_hyphens": occurrences(u, "-"),
        "count_underscores": occurrences(u, "_"), "count_at": occurrences(u, "@"),
        "count_percent": occurrences(u, "%"), "count_query_marks": occurrences(u, "?"),
        "count_ampersand": occurrences(u, "&"), "count_equal": occurrences(u, "="),
        "count_digits": digits, "count_letters": letters, "count_subdomains": occurrences(domain, "."),
        "digit_ratio": digits / (length + 1), "letter_ratio": letters / (length + 1),
        "has_ip": bit(is_address), "has_at": bit(u.contains("@")),
        "has_https": bit(F.lower(u).startswith("https:")),
        "has_tinyurl": bit(contains_any(u, lx.FEATURE_SHORTENERS)),
        "has_prefix_suffix": bit(domain.contains("-")), "has_punycode": bit(domain.contains("xn--")),
        "url_entropy": entropy_bits(u), "domain_entropy": entropy_bits(domain),
        "is_suspicious_tld": bit(F.substring_index(domain, ".", -1).isin(lx.FEATURE_TLDS)),
        "has_brand_name": bit(contains_any(F.lower(u), lx.FEATURE_BRANDS)),
        "count_non_alphanumeric": F.regexp_count(u, F.lit(r"[^\p{L}\p{N}]")),
        "is_encoded": bit(u.contains("%")),
        "double_slash_redirection": bit(u.contains("//") & (last_slashes > 7)),
    }


def heuristic_url_score(f: dict[str, Column] | None = None) -> Column:
    """Fallback score over the feature columns of ``lexical_features``."""
    c = f or {n: F.col(n) for n in (
        "is_suspicious_tld", "has_ip", "url_length", "digit_ratio", "domain_entropy", "has_brand_name", "has_https")}
    rules = [
        (c["is_suspicious_tld"] == 1, 0.4), (c["has_ip"] == 1, 0.5), (c["url_length"] > 75, 0.2),
        (c["digit_ratio"] > 0.3, 0.3), (c["domain_entropy"] > 4.0, 0.3),
        ((c["has_brand_name"] == 1) & (c["has_https"] == 0), 0.4),
    ]
    total = reduce(lambda a, r: a + F.when(r[0], r[1]).otherwise(0.0), rules, F.lit(0.0))
    return F.least(F.lit(1.0), total)


def overridden_probability(prob: Column, url: Column | str) -> Column:
    """Raise a model probability on evidence the model may miss."""
    safe = contains_any(F.lower(text(url)), lx.OVERRIDE_SAFE_HOSTS)
    raised = F.when(F.col("has_ip") == 1, F.greatest(prob, F.lit(0.96))).otherwise(prob)
    mimic = (F.col("has_brand_name") == 1) & (F.col("has_https") == 0) & ~safe
    return F.when(mimic, F.greatest(raised, F.lit(0.75))).otherwise(raised)


def probability_label(prob: Column) -> Column:
    return F.when(prob > 0.85, "DANGEROUS").when(prob > 0.45, "SUSPICIOUS").otherwise("SAFE")


def mobile_features(url: Column | str) -> dict[str, Column]:
    """The 14-value vector of the mobile URL model."""
    u = text(url)
    lower = F.lower(u)
    host, query, path = raw_host_of(u), query_of(u), path_of(u)
    bit = lambda c: c.cast("int")
    return {
        "url_length": F.length(u), "domain_length": F.length(host),
        "qty_digits": F.regexp_count(u, F.lit(r"\p{Nd}")), "qty_dots": occurrences(u, "."),
        "qty_hyphens": occurrences(u, "-"), "has_https": bit(lower.startswith("https")),
        "qty_subdomains": F.greatest(F.size(F.split(host, r"\.")) - 2, F.lit(0)),
        "url_entropy": entropy_bits(u),
        "has_suspicious_keyword": bit(contains_any(lower, lx.MOBILE_URL_KEYWORDS)),
        "qty_special_chars": F.regexp_count(u, F.lit(r"[^\p{L}\p{Nd}/:.?=]")),
        "url_depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")),
        "is_ip": bit(host.rlike(IPV4_HOST)),
        "is_suspicious_tld": bit(host.rlike(alternation(lx.MOBILE_URL_TLDS) + "$")),
        "query_length": F.length(query),
    }


def url_codes(url: Column | str, width: int = 200) -> Column:
    """Character codes 1..127 of a URL, zero-padded to the model width."""
    codes = F.transform(
        F.filter(F.split(F.substring(F.lower(text(url)), 1, width), ""), lambda ch: ch != ""),
        lambda ch: clamp(F.ascii(ch), 1, 127))
    return F.slice(F.concat(codes, F.array_repeat(F.lit(0), width)), 1, width)


def trim_url(c: Column) -> Column:
    return F.rtrim(c, F.lit(".,;:)]}>\"'"))


def dangerous_target(url: Column | str) -> Column:
    """Does the path of the URL end in an executable extension?"""
    target = F.substring_index(F.substring_index(F.lower(trim_url(col(url))), "?", 1), "#", 1)
    return target.rlike(alternation(lx.DANGEROUS_TARGET_EXTENSIONS) + "$")
