"""Mail header rules: addresses, relay hops, authentication results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.functions.common import alternation, any_of, col, compact, let, strip, text

IP_CANDIDATES = (
    r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f:.]*:)[0-9A-Fa-f:.]+(?![0-9A-Za-z])"
    r"|(?<![0-9.])(?:\d{1,3}\.){3}\d{1,3}(?![0-9.])"
)
_STRICT_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
STRICT_IPV4 = rf"^{_STRICT_OCTET}(?:\.{_STRICT_OCTET}){{3}}$"
_HEX_GROUPS = r"(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?"
IPV6_SHAPE = rf"^{_HEX_GROUPS}(?:::{_HEX_GROUPS})?$"
# IPv6 ranges by class as patterns over the 32 hex digits, in test order.
IPV6_CLASSES = [
    ("LOOPBACK", "^0{31}1$"),
    ("LINK_LOCAL", "^fe[89ab]"),
    ("PUBLIC", "^(20010001000000000000000000000001|20010001000000000000000000000002|20010003|"
               "200100040112|2001002|2001003)"),
    ("PRIVATE", "^(0{32}$|0064ff9b0001|0100000000000000|200100|200101|20010db8|2002|f[cd])"),
    ("RESERVED", "^(00|01|0[2-7]|0[89a-f]|1|[4-9a-d]|e|f[0-7]|f[89ab]|fe[0-7]|ff)"),
]


def ipv4_number(c: Column) -> Column:
    part = lambda i: F.split_part(c, F.lit("."), F.lit(i)).cast("bigint")
    return ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)


def _cidr(network: str) -> tuple[int, int]:
    base, bits = network.split("/")
    a, b, c, d = (int(x) for x in base.split("."))
    low = ((a * 256 + b) * 256 + c) * 256 + d
    return low, low + (1 << (32 - int(bits))) - 1


def _ipv4_class(c: Column) -> Column:
    def rate(number: Column) -> Column:
        chain = F.when(number.isNull(), "INVALID")
        for name, networks in lx.IPV4_CLASSES:
            chain = chain.when(any_of(number.between(*_cidr(n)) for n in networks), name)
        return chain.otherwise("PUBLIC")

    return let(F.when(c.rlike(STRICT_IPV4), ipv4_number(c)), rate)


def ipv6_digits(c: Column) -> Column:
    """The 32 hex digits of an IPv6 literal, NULL when it is not one."""
    def plain(lower: Column) -> Column:
        # A trailing dotted quad becomes two hex groups.
        def rewrite(tail: Column) -> Column:
            number = ipv4_number(tail)
            head = F.substring(lower, F.lit(1), F.length(lower) - F.length(tail))
            groups = F.concat(head, F.lower(F.hex(F.floor(number / 65536))), F.lit(":"), F.lower(F.hex(number % 65536)))
            return F.when(tail == "", lower).when(tail.rlike(STRICT_IPV4), groups)

        return let(F.regexp_extract(lower, r":(\d+\.\d+\.\d+\.\d+)$", 1), rewrite)

    groups = lambda h: F.filter(F.split(h, ":"), lambda g: g != "")

    def fill(halves: Column) -> Column:
        two = F.size(halves) == 2
        sides = F.struct(
            groups(halves[0]).alias("left"),
            F.when(two, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("right"))

        def join(s: Column) -> Column:
            used = F.size(s["left"]) + F.size(s["right"])
            fits = F.when(two, used <= 7).otherwise(used == 8)
            filled = F.concat(s["left"], F.array_repeat(F.lit("0"), F.greatest(8 - used, F.lit(0))), s["right"])
            return F.when(fits, F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), ""))

        return let(sides, join)

    return let(let(F.lower(c), plain), lambda base: F.when(base.rlike(IPV6_SHAPE), let(F.split(base, "::", -1), fill)))


def _mapped_class(inner: Column) -> Column:
    """IPv4-mapped addresses keep the local classes; all others lie in a reserved block."""
    return F.when(inner == "LOOPBACK", inner).when(inner.isin("LINK_LOCAL", "PRIVATE"), "PRIVATE").otherwise("RESERVED")


def _ipv6_class(c: Column) -> Column:
    def rate(digits: Column) -> Column:
        octets = [F.conv(F.substring(digits, 25 + 2 * i, 2), 16, 10) for i in range(4)]
        mapped = digits.rlike("^0{20}ffff")
        chain = F.when(digits.isNull(), "INVALID").when(mapped, _mapped_class(_ipv4_class(F.concat_ws(".", *octets))))
        for name, pattern in IPV6_CLASSES:
            chain = chain.when(digits.rlike(pattern), name)
        return chain.otherwise("PUBLIC")

    return let(ipv6_digits(c), rate)


def ip_class(c: Column | str) -> Column:
    """LOOPBACK, LINK_LOCAL, PRIVATE, RESERVED, PUBLIC or INVALID, all in the JVM."""
    return let(strip(text(c)), lambda v: F.when(v.contains(":"), _ipv6_class(v)).otherwise(_ipv4_class(v)))


def ip_version(c: Column | str) -> Column:
    value = strip(text(c))
    return (
        F.when(value.rlike(STRICT_IPV4), 4)
        .when(value.contains(":") & ipv6_digits(value).isNotNull(), 6)
    )


def ip_candidates(c: Column) -> Column:
    """Valid addresses in a header fragment as ``array<struct<ip, ip_class>>``."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(IP_CANDIDATES), F.lit(0)))
    rated = F.transform(found, lambda ip: F.struct(ip.alias("ip"), ip_class(ip).alias("ip_class")))
    return F.filter(rated, lambda r: r["ip_class"] != "INVALID")


def address_part(header: Column) -> Column:
    """A header without brackets and without the timestamp after the semicolon."""
    return F.translate(F.substring_index(text(header), ";", 1), "[]", "  ")


def infrastructure(ip: Column, org: Column | str) -> Column:
    """Kind of network behind an address, from its organisation text."""
    return let(F.lower(text(org)), lambda lower: (
        F.when(lower.rlike(alternation(lx.VPN_TERMS)), "VPN_PROXY")
        .when(lower.rlike(r"\btor\b"), "TOR_EXIT")
        .when(lower.rlike(alternation(lx.CLOUD_TERMS)), "DATACENTER_CLOUD")
        .when(lower.rlike(alternation(lx.HOSTING_TERMS)), "HOSTING_PROVIDER")
        .when(ip_class(ip) != "PUBLIC", "INTERNAL_RESERVED")
        .when(lower != "", "RESIDENTIAL")
        .otherwise("UNKNOWN")))


def parse_hop(header: Column | str) -> Column:
    """One ``Received`` header as a relay hop."""
    def facts(raw: Column) -> Column:
        def choose(found: Column) -> Column:
            public = F.filter(found, lambda r: r["ip_class"] == "PUBLIC")
            return F.coalesce(F.get(public, F.lit(0)), F.get(found, F.lit(0)))

        def host(word: str) -> Column:
            return let(F.regexp_extract(raw, rf"(?i){word}\s+([^\s;()]+)", 1), lambda h: F.when(h == "", "unknown").otherwise(h))

        return F.struct(
            host("from").alias("from_host"), host("by").alias("by_host"),
            let(ip_candidates(address_part(raw)), choose).alias("at"))

    def label(f: Column) -> Column:
        kind = F.coalesce(f["at"]["ip_class"], F.lit("NONE"))
        trust = (
            F.when(f["by_host"] == "unknown", "POSSIBLY_FORGED")
            .when(F.lower(f["by_host"]).rlike(alternation(lx.TRUSTED_MTAS)), "TRUSTED_RELAY")
            .when(~kind.isin("NONE", "PUBLIC"), "SUSPICIOUS_RELAY").otherwise("OBSERVED"))
        return F.struct(f.alias("f"), kind.alias("kind"), trust.alias("trust"))

    def explain(x: Column) -> Column:
        f, kind, trust = x["f"], x["kind"], x["trust"]
        reason = (
            F.when(trust == "POSSIBLY_FORGED", F.lit("Missing 'by' MTA field in Received header syntax"))
            .when(trust == "TRUSTED_RELAY", F.concat(
                F.lit("Received and signed by trusted major mail provider ("), f["by_host"], F.lit(")")))
            .when(trust == "SUSPICIOUS_RELAY", F.concat(
                F.lit("Hop claims non-routable "), kind, F.lit(" address in transmission path")))
            .when(kind == "PUBLIC", "External routing infrastructure observed")
            .otherwise("Standard relay hop observation"))
        return F.struct(
            f["from_host"].alias("from_host"), f["by_host"].alias("by_host"), f["at"]["ip"].alias("ip"),
            kind.alias("ip_class"), trust.alias("trust_label"), reason.alias("trust_reason"))

    return let(let(let(strip(text(header)), facts), label), explain)


# -- authentication --------------------------------------------------------

_SPF = "pass|fail|softfail|neutral|none|temperror|permerror"
_DKIM = "pass|fail|neutral|none|temperror|permerror"
_DMARC = "pass|fail|bestguesspass|none|temperror|permerror"


def parse_auth(header: Column | str) -> Column:
    """SPF, DKIM and DMARC verdicts with the derived authorization status."""
    def read(lower: Column) -> Column:
        def check(name: str, values: str, detail: str, missing: str) -> Column:
            seen = F.struct(
                F.upper(F.regexp_extract(lower, rf"{name}\s*=\s*({values})", 1)).alias("raw"),
                strip(F.regexp_extract(lower, detail, 1)).alias("detail"))
            return let(seen, lambda s: F.struct(
                F.when(s["raw"] == "", "UNKNOWN").when(s["raw"] == "BESTGUESSPASS", "PASS").otherwise(s["raw"]).alias("status"),
                F.when(lower == "", "No Authentication-Results header found").when(s["raw"] == "", F.lit(missing))
                .when(s["detail"] == "", s["raw"]).otherwise(s["detail"]).alias("detail")))

        return F.struct(
            check("spf", _SPF, r"spf\s*=\s*\w+\s*\(([^)]+)\)", "No SPF record evaluated in Authentication-Results").alias("spf"),
            check("dkim", _DKIM, r"dkim\s*=\s*\w+\s*([^;]+)", "No DKIM signature evaluated in Authentication-Results").alias("dkim"),
            check("dmarc", _DMARC, r"dmarc\s*=\s*\w+\s*\(([^)]+)\)", "No DMARC policy evaluated in Authentication-Results").alias("dmarc"))

    def decide(r: Column) -> Column:
        statuses = F.array(*[r[n]["status"] for n in ("spf", "dkim", "dmarc")])
        return F.struct(
            *[r[n]["status"].alias(n) for n in ("spf", "dkim", "dmarc")],
            *[r[n]["detail"].alias(f"{n}_detail") for n in ("spf", "dkim", "dmarc")],
            F.when(F.array_contains(statuses, "FAIL"), "DOMAIN_UNAUTHORIZED")
            .when(F.forall(statuses, lambda s: s == "PASS"), "DOMAIN_AUTHORIZED")
            .otherwise("PARTIAL_OR_UNAVAILABLE").alias("authorization"))

    return let(let(F.lower(text(header)), read), decide)


def auth_status(header: Column | str, protocol: str) -> Column:
    return parse_auth(header)[protocol]


def auth_score(auth: Column) -> Column:
    """0-99 penalty of the three checks; zero when nothing is known."""
    total = F.lit(0)
    for name in ("spf", "dkim", "dmarc"):
        s = auth[name]
        total = total + (
            F.when(s == "FAIL", 33).when(s == "SOFTFAIL", 25)
            .when(s.isin("UNKNOWN", "NONE", "TEMPERROR", "PERMERROR"), 10).otherwise(0))
    return F.when(has_auth(auth), total).otherwise(0)


def has_auth(auth: Column) -> Column:
    return any_of(auth[n] != "UNKNOWN" for n in ("spf", "dkim", "dmarc"))


def explain_auth(protocol: str, status: Column) -> Column:
    """Explanation text for a protocol and its status."""
    rows = {s: t for p, s, t in lx.AUTH_EXPLANATIONS if p == protocol}
    chain = F.when(status == "PASS", rows["PASS"]).when(status == "FAIL", rows["FAIL"])
    if "SOFTFAIL" in rows:
        chain = chain.when(status == "SOFTFAIL", rows["SOFTFAIL"])
    return chain.otherwise(rows["OTHER"])


# -- raw header blocks -----------------------------------------------------

def header_lines(c: Column | str) -> Column:
    """Header lines with folded continuation lines joined."""
    return F.split(F.regexp_replace(text(c), r"\r?\n[ \t]+", " "), r"\r?\n")


def header_map(c: Column | str) -> Column:
    """Lower-cased header names to values; repeated headers are concatenated."""
    lines = F.filter(header_lines(c), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(lines, lambda x: F.struct(
        F.lower(strip(F.substring_index(x, ":", 1))).alias("k"),
        strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))

    def merge(p: Column) -> Column:
        names = F.array_distinct(F.transform(p, lambda e: e["k"]))
        return F.map_from_entries(F.transform(names, lambda n: F.struct(
            n.alias("k"),
            F.array_join(F.transform(F.filter(p, lambda e: e["k"] == n), lambda e: e["v"]), "").alias("v"))))

    return let(pairs, merge)


def received_lines(c: Column | str) -> Column:
    return F.filter(F.split(text(c), r"\r?\n"), lambda x: F.lower(x).startswith("received:"))


_ANY_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"


def mobile_headers(c: Column | str) -> Column:
    """The simpler on-device reading of a raw header block."""
    def status(auth: Column, name: str, values: str) -> Column:
        return let(F.upper(F.regexp_extract(auth, rf"(?i){name}=({values})", 1)), lambda s: F.when(s == "", "NONE").otherwise(s))

    def mailbox(value: Column) -> Column:
        return let(F.regexp_extract(value, r"<([^>]*)>", 1), lambda inner: F.lower(strip(F.when(inner != "", inner).otherwise(value))))

    def domain(value: Column) -> Column:
        return F.when(value.contains("@"), strip(F.substring(value, F.instr(value, "@") + 1, F.length(value)))).otherwise("")

    def read(h: Column) -> Column:
        auth = F.coalesce(h["map"]["authentication-results"], F.lit(""))
        sender = F.coalesce(h["map"]["from"], F.lit(""))
        ips = F.transform(h["hops"], lambda r: F.regexp_extract(r, rf"\b(?:{_ANY_OCTET}\.){{3}}{_ANY_OCTET}\b", 0))
        routable = F.filter(ips, lambda ip: (ip != "") & ~ip.rlike(r"^(10\.|192\.168\.|127\.|172\.16\.)"))
        return F.struct(
            status(auth, "spf", "pass|fail|softfail|neutral|none").alias("spf"),
            status(auth, "dkim", "pass|fail|neutral|none").alias("dkim"), status(auth, "dmarc", "pass|fail|none").alias("dmarc"),
            F.get(routable, F.lit(0)).alias("originating_ip"), F.size(h["hops"]).alias("hop_count"), sender.alias("sender"),
            mailbox(sender).alias("box"), mailbox(F.coalesce(h["map"]["reply-to"], F.lit(""))).alias("reply"))

    def decide(r: Column) -> Column:
        failed = any_of(r[n] == "FAIL" for n in ("spf", "dkim", "dmarc"))
        return F.struct(
            *[r[n].alias(n) for n in ("spf", "dkim", "dmarc", "originating_ip", "hop_count")],
            failed.alias("relay_suspicious"),
            ((r["box"] != "") & (r["reply"] != "") & (domain(r["box"]) != domain(r["reply"]))).alias("reply_mismatch"),
            r["sender"].alias("sender"))

    facts = F.struct(header_map(c).alias("map"), received_lines(c).alias("hops"))
    return let(let(facts, read), decide)


def bracket_value(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit("[] \t\r\n"))


def auth_sender_ip(header: Column | str) -> Column:
    found = F.regexp_extract(text(header), r"(?i)sender\s+IP\s+is\s+([0-9a-fA-F.:]+)", 1)
    return F.when(found != "", found)
