"""Queries over mail headers, relay paths and domain facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.functions import fusion
from riskframe.functions import headers as hx
from riskframe.operators import enrichment as en
from riskframe.plans.datasets import MAIL_SQL, mail, table
from riskframe.plans.registry import query
from riskframe.plans.sqltext import has_any, quoted
from riskframe.session import checkpointed

_SPF, _DKIM, _DMARC = hx._SPF, hx._DKIM, hx._DMARC


def _status(name: str, values: str) -> str:
    x = f"upper(regexp_extract(lower(h), '{name}\\s*=\\s*({values})', 1))"
    return f"CASE {x} WHEN '' THEN 'UNKNOWN' WHEN 'BESTGUESSPASS' THEN 'PASS' ELSE {x} END"


_AUTH_CTE = f"""m AS (SELECT email_id, authentication_results AS h FROM ({MAIL_SQL})),
a AS (SELECT email_id, h, {_status('spf', _SPF)} AS spf, {_status('dkim', _DKIM)} AS dkim, {_status('dmarc', _DMARC)} AS dmarc FROM m)"""
_PEN = "CASE {c} WHEN 'FAIL' THEN 33 WHEN 'SOFTFAIL' THEN 25 WHEN 'UNKNOWN' THEN 10 WHEN 'NONE' THEN 10 WHEN 'TEMPERROR' THEN 10 WHEN 'PERMERROR' THEN 10 ELSE 0 END"


@query("auth_results", f"""
WITH {_AUTH_CTE}
SELECT email_id, spf, dkim, dmarc,
  CASE WHEN 'FAIL' IN (spf, dkim, dmarc) THEN 'DOMAIN_UNAUTHORIZED' WHEN spf = 'PASS' AND dkim = 'PASS' AND dmarc = 'PASS' THEN 'DOMAIN_AUTHORIZED'
    ELSE 'PARTIAL_OR_UNAVAILABLE' END AS authorization,
  CASE WHEN h = '' THEN 'No Authentication-Results header found' WHEN regexp_extract(lower(h), 'spf\\s*=\\s*({_SPF})', 1) = '' THEN 'No SPF record evaluated in Authentication-Results'
    WHEN regexp_extract(lower(h), 'spf\\s*=\\s*\\w+\\s*\\(([^)]+)\\)', 1) <> '' THEN regexp_extract(lower(h), 'spf\\s*=\\s*\\w+\\s*\\(([^)]+)\\)', 1)
    ELSE upper(regexp_extract(lower(h), 'spf\\s*=\\s*({_SPF})', 1)) END AS spf_detail,
  CASE WHEN spf = 'UNKNOWN' AND dkim = 'UNKNOWN' AND dmarc = 'UNKNOWN' THEN 0 ELSE {_PEN.format(c='spf')} + {_PEN.format(c='dkim')} + {_PEN.format(c='dmarc')} END AS auth_score
FROM a""")
def auth_results(spark, sf):
    a = mail(spark, sf).select("email_id", hx.parse_auth("authentication_results").alias("a"))
    return a.select("email_id", "a.spf", "a.dkim", "a.dmarc", "a.authorization", "a.spf_detail",
                    hx.auth_score(F.col("a")).alias("auth_score"))


_EXPLAIN = " ".join(
    f"WHEN protocol = {quoted(p)} AND {'true' if s == 'OTHER' else f'status = {quoted(s)}'} THEN {quoted(t)}" for p, s, t in lx.AUTH_EXPLANATIONS)


@query("auth_explanations", f"""
WITH {_AUTH_CTE}, l AS (SELECT email_id, 'SPF' AS protocol, spf AS status FROM a UNION ALL SELECT email_id, 'DKIM', dkim FROM a
  UNION ALL SELECT email_id, 'DMARC', dmarc FROM a)
SELECT email_id, protocol, status, CASE {_EXPLAIN} END AS explanation FROM l""")
def auth_explanations(spark, sf):
    a = mail(spark, sf).select("email_id", hx.parse_auth("authentication_results").alias("a"))
    rows = F.array(*[F.struct(
        F.lit(p).alias("protocol"), F.col(f"a.{p.lower()}").alias("status"),
        hx.explain_auth(p, F.col(f"a.{p.lower()}")).alias("explanation")) for p in ("SPF", "DKIM", "DMARC")])
    return a.select("email_id", F.inline(rows))


# -- relay path ------------------------------------------------------------

def _v4_class(c: str) -> str:
    n = " + ".join(f"CAST(split_part({c}, '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5))
    parts = []
    for name, networks in lx.IPV4_CLASSES:
        tests = " OR ".join(f"({n}) BETWEEN {a} AND {b}" for a, b in map(hx._cidr, networks))
        parts.append(f"WHEN {tests} THEN '{name}'")
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'INVALID' {' '.join(parts)} ELSE 'PUBLIC' END"


_HOP_ROWS = f"""m AS ({MAIL_SQL}),
r AS (SELECT email_id, low_hop AS h, 1 AS hop_index FROM m WHERE n_hops = 2 UNION ALL
      SELECT email_id, top_hop, 2 FROM m WHERE n_hops = 2 UNION ALL SELECT email_id, top_hop, 1 FROM m WHERE n_hops = 1),
c AS (SELECT *, regexp_extract(h, '\\[(\\d+\\.\\d+\\.\\d+\\.\\d+)\\]', 1) AS ip,
  regexp_extract(h, '(?i)from\\s+([^\\s;()]+)', 1) AS from_host, regexp_extract(h, '(?i)by\\s+([^\\s;()]+)', 1) AS by0 FROM r),
k AS (SELECT email_id, hop_index, ip, from_host, CASE WHEN by0 = '' THEN 'unknown' ELSE by0 END AS by_host, {_v4_class('ip')} AS ip_class FROM c),
hops AS (SELECT *, CASE WHEN by_host = 'unknown' THEN 'POSSIBLY_FORGED' WHEN {has_any('lower(by_host)', lx.TRUSTED_MTAS)} THEN 'TRUSTED_RELAY'
  WHEN ip_class <> 'PUBLIC' THEN 'SUSPICIOUS_RELAY' ELSE 'OBSERVED' END AS trust_label FROM k)"""


@query("relay_hops", f"WITH {_HOP_ROWS} SELECT email_id, hop_index, ip, from_host, by_host, ip_class, trust_label FROM hops")
def relay_hops(spark, sf):
    return en.relay_hops(mail(spark, sf)).drop("trust_reason")


@query("origin_ip", f"""
WITH {_HOP_ROWS}, f AS (SELECT email_id, min_by(ip, hop_index) AS ip, min(hop_index) AS n FROM hops WHERE ip_class = 'PUBLIC' GROUP BY 1),
x AS (SELECT m.email_id, n_hops, f.ip AS fip, f.n, trim(x_originating_ip, '[]') AS xo, regexp_extract(authentication_results, '(?i)sender\\s+IP\\s+is\\s+([0-9a-fA-F.:]+)', 1) AS sp
  FROM m LEFT JOIN f ON m.email_id = f.email_id)
SELECT email_id, CASE WHEN fip IS NOT NULL THEN fip WHEN {_v4_class('xo')} = 'PUBLIC' THEN xo WHEN n_hops > 0 AND {_v4_class('sp')} = 'PUBLIC' THEN sp
  ELSE 'ORIGIN_NOT_DETERMINABLE' END AS origin_ip,
  CASE WHEN fip IS NOT NULL THEN concat('Hop ', n, ' was the earliest publicly routable IP in the transmission path.')
  WHEN {_v4_class('xo')} = 'PUBLIC' THEN CASE WHEN n_hops = 0 THEN 'Identified from x-originating-ip header (Received headers absent).' ELSE 'Cross-checked from authenticated x-originating-ip header.' END
  WHEN n_hops > 0 AND {_v4_class('sp')} = 'PUBLIC' THEN 'Extracted from SPF sender IP evaluation in Authentication-Results.'
  WHEN n_hops = 0 THEN 'No Received headers present in email metadata.' ELSE 'All observed hops represent private, loopback, or non-routable addresses.' END AS reason FROM x""")
def origin_ip(spark, sf):
    m = mail(spark, sf)
    origin = en.origin_ip(en.hop_array("received_headers"), F.col("received_headers"), F.col("raw_headers"))
    return m.select("email_id", origin.alias("o")).select("email_id", F.col("o.ip").alias("origin_ip"), "o.reason")


@query("observed_ips", f"""
WITH {_HOP_ROWS}, s AS (SELECT email_id, ip, 'Received' AS source_header, hop_index, hop_index AS o FROM hops
  UNION ALL SELECT email_id, trim(x_originating_ip, '[]'), 'x-originating-ip', NULL, 100 FROM m WHERE x_originating_ip <> ''
  UNION ALL SELECT email_id, regexp_extract(authentication_results, '(\\d+\\.\\d+\\.\\d+\\.\\d+)', 1), 'Authentication-Results', NULL, 200 FROM m),
d AS (SELECT *, row_number() OVER (PARTITION BY email_id, ip ORDER BY o) AS rn FROM s WHERE ip <> '')
SELECT email_id, ip, {_v4_class('ip')} AS ip_class, source_header, hop_index FROM d WHERE rn = 1""")
def observed_ips(spark, sf):
    return en.observed_ips(mail(spark, sf)).drop("sighting")


def _geo_dim(spark, sf, hops):
    """Address snapshot: the first octet of each public address picks a row of the nation table."""
    nations = table(spark, sf, "nation")
    ips = hops.filter("ip_class = 'PUBLIC'").select("ip").distinct()
    keyed = ips.withColumn("n_nationkey", F.pmod(F.split_part("ip", F.lit("."), F.lit(1)).cast("int"), F.lit(25)))
    code = F.expr("split_part('RU|US|DE|CN|IN|FR|NG', '|', n_nationkey % 7 + 1)")
    org = F.expr("split_part('NordVPN AS|Google LLC|Acme Hosting|Home Cable|Tor node|Storage Corp|', '|', n_nationkey % 7 + 1)")
    return keyed.join(F.broadcast(nations), "n_nationkey").select(
        "ip", F.col("n_name").alias("country"), code.alias("country_code"), org.alias("org"),
        (F.col("n_nationkey") * 1.5 - 10).alias("lat"), (F.col("n_nationkey") * 3.0).alias("lon"))


def _located_hops(spark, sf):
    """Parsed hops, written once, with their snapshot."""
    hops = checkpointed(en.relay_hops(mail(spark, sf)))
    return en.enrich_hops(hops, _geo_dim(spark, sf, hops))


_GEO_SQL = """g AS (SELECT ip, n_name AS country, split_part('RU|US|DE|CN|IN|FR|NG', '|', CAST(k % 7 + 1 AS INT)) AS code,
  split_part('NordVPN AS|Google LLC|Acme Hosting|Home Cable|Tor node|Storage Corp|', '|', CAST(k % 7 + 1 AS INT)) AS org, k * 1.5 - 10 AS lat, k * 3.0 AS lon
  FROM (SELECT DISTINCT ip, CAST(split_part(ip, '.', 1) AS INT) % 25 AS k FROM hops WHERE ip_class = 'PUBLIC') JOIN nation ON n_nationkey = k)"""


@query("hop_geolocation", f"""
WITH {_HOP_ROWS}, {_GEO_SQL}
SELECT email_id, hop_index, g.country AS geo_country, CASE WHEN g.ip IS NOT NULL THEN 'Public routable relay; approximate infrastructure location shown.'
  WHEN ip_class = 'PUBLIC' THEN 'Public relay; geolocation lookup unavailable.'
  ELSE concat('Internal relay (', lower(ip_class), ') — not routable; no geolocation applicable.') END AS note
FROM hops LEFT JOIN g ON hops.ip = g.ip AND hops.ip_class = 'PUBLIC'""")
def hop_geolocation(spark, sf):
    return _located_hops(spark, sf).select("email_id", "hop_index", "geo_country", "note")


@query("relay_anomaly", f"""
WITH {_HOP_ROWS}, {_GEO_SQL}, d AS (SELECT email_id, hops.ip, code, org, min(hop_index) FROM hops JOIN g ON hops.ip = g.ip WHERE ip_class = 'PUBLIC' GROUP BY ALL),
t AS (SELECT *, CASE WHEN {has_any('lower(org)', lx.VPN_TERMS)} THEN 'V' WHEN regexp_matches(lower(org), '\\btor\\b') THEN 'V'
  WHEN {has_any('lower(org)', lx.CLOUD_TERMS)} OR {has_any('lower(org)', lx.HOSTING_TERMS)} THEN 'C' ELSE 'R' END AS k FROM d)
SELECT email_id, count(*) AS relay_count, count(DISTINCT code) AS country_count, array_to_string(list_sort(list(DISTINCT code)), ',') AS countries,
  count_if(code IN ('RU','CN','NG','KP','IR')) AS high_risk_hops, count_if(k = 'V') AS hidden_hops, count_if(k = 'C') AS cloud_hops,
  CAST(least(100, sum(CASE WHEN code IN ('RU','CN','NG','KP','IR') THEN 25 ELSE 0 END + CASE WHEN k = 'V' THEN 20 ELSE 0 END)
    + CASE WHEN count(DISTINCT code) > 3 THEN 20 ELSE 0 END) AS INT) AS anomaly_score FROM t GROUP BY 1""")
def relay_anomaly(spark, sf):
    return en.relay_anomaly(_located_hops(spark, sf))


@query("map_hops", f"""
WITH {_HOP_ROWS}, {_GEO_SQL} SELECT email_id, hop_index, hops.ip, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM hops JOIN g ON hops.ip = g.ip
WHERE ip_class = 'PUBLIC' AND lat <> 0 AND lon <> 0 AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180""")
def map_hops(spark, sf):
    hops = en.plottable_hops(_located_hops(spark, sf))
    return hops.select("email_id", "hop_index", "ip", F.col("geo_lat").cast("double").alias("lat"), F.col("geo_lon").cast("double").alias("lon"))


_IP6 = ["fe80::1", "2001:db8::5", "2607:f8b0:4005:805::200e", "::1", "fc00::7", "::ffff:8.8.8.8", "2002:c000:204::1", "ff02::1", "1:2:3", "::ffff:10.0.0.1"]
_IP6_CLASS = ["LINK_LOCAL", "PRIVATE", "PUBLIC", "LOOPBACK", "PRIVATE", "RESERVED", "PRIVATE", "RESERVED", "INVALID", "PRIVATE"]
_PICK6 = "split_part('{v}', '|', CAST(c_custkey % 10 AS INT) + 1)"
_V4 = "concat(CAST(c_custkey * 37 % 256 AS INT), '.', CAST(c_custkey * 11 % 256 AS INT), '.', CAST(c_nationkey AS INT), '.', CAST(c_custkey % 256 AS INT))"


@query("ip_classes", f"""
SELECT c_custkey, ip, {_v4_class('ip')} AS ip_class, 4 AS ip_version, ip6, {_PICK6.format(v='|'.join(_IP6_CLASS))} AS ip6_class
FROM (SELECT c_custkey, {_V4} AS ip, {_PICK6.format(v='|'.join(_IP6))} AS ip6 FROM customer)""")
def ip_classes(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey", f"{_V4} AS ip", f"{_PICK6.format(v='|'.join(_IP6))} AS ip6")
    return df.select("c_custkey", "ip", hx.ip_class("ip").alias("ip_class"), hx.ip_version("ip").alias("ip_version"), "ip6",
                     hx.ip_class("ip6").alias("ip6_class"))


@query("infrastructure_types", f"""
SELECT s_suppkey, org, CASE WHEN {has_any('lower(org)', lx.VPN_TERMS)} THEN 'VPN_PROXY' WHEN regexp_matches(lower(org), '\\btor\\b') THEN 'TOR_EXIT'
  WHEN {has_any('lower(org)', lx.CLOUD_TERMS)} THEN 'DATACENTER_CLOUD' WHEN {has_any('lower(org)', lx.HOSTING_TERMS)} THEN 'HOSTING_PROVIDER'
  WHEN {_v4_class('ip')} <> 'PUBLIC' THEN 'INTERNAL_RESERVED' WHEN org <> '' THEN 'RESIDENTIAL' ELSE 'UNKNOWN' END AS infrastructure
FROM (SELECT s_suppkey, concat(split_part('10|8|52|192', '|', CAST(s_suppkey % 4 AS INT) + 1), '.168.1.', CAST(s_suppkey % 256 AS INT)) AS ip,
  split_part('ExpressVPN|Tor Exit|AWS EC2|Data Center One|Storage tor|Home ISP||Torrent Inc', '|', CAST(s_suppkey % 8 AS INT) + 1) AS org FROM supplier)""")
def infrastructure_types(spark, sf):
    df = table(spark, sf, "supplier").selectExpr(
        "s_suppkey", "concat(split_part('10|8|52|192', '|', CAST(s_suppkey % 4 AS INT) + 1), '.168.1.', CAST(s_suppkey % 256 AS INT)) AS ip",
        "split_part('ExpressVPN|Tor Exit|AWS EC2|Data Center One|Storage tor|Home ISP||Torrent Inc', '|', CAST(s_suppkey % 8 AS INT) + 1) AS org")
    return df.select("s_suppkey", "org", hx.infrastructure(F.col("ip"), "org").alias("infrastructure"))


# -- raw header block ------------------------------------------------------

_RAW = ("concat('From: ', sender, chr(10), 'Reply-To: ', reply_to, chr(10), 'Subject: ', subject, chr(13), chr(10), '  folded', chr(10), 'Received: ', top_hop, chr(10), "
        "'Authentication-Results: ', authentication_results, chr(10), 'received: ', low_hop)")


@query("mobile_header_parse", f"""
WITH m AS (SELECT email_id, authentication_results AS a, subject, sender, reply_to, top_hop, low_hop FROM ({MAIL_SQL})),
s AS (SELECT *, upper(regexp_extract(a, '(?i)spf=(pass|fail|softfail|neutral|none)', 1)) AS s1, upper(regexp_extract(a, '(?i)dkim=(pass|fail|neutral|none)', 1)) AS s2,
  upper(regexp_extract(a, '(?i)dmarc=(pass|fail|none)', 1)) AS s3, regexp_extract(top_hop, '\\[(\\d+\\.\\d+\\.\\d+\\.\\d+)\\]', 1) AS i1,
  regexp_extract(low_hop, '\\[(\\d+\\.\\d+\\.\\d+\\.\\d+)\\]', 1) AS i2,
  lower(trim(CASE WHEN contains(sender, '<') THEN regexp_extract(sender, '<([^>]*)>', 1) ELSE sender END)) AS box, lower(trim(reply_to)) AS rep FROM m)
SELECT email_id, CASE s1 WHEN '' THEN 'NONE' ELSE s1 END AS spf, CASE s2 WHEN '' THEN 'NONE' ELSE s2 END AS dkim, CASE s3 WHEN '' THEN 'NONE' ELSE s3 END AS dmarc,
  CASE WHEN NOT regexp_matches(i1, '^(10\\.|192\\.168\\.|127\\.|172\\.16\\.)') THEN i1 WHEN NOT regexp_matches(i2, '^(10\\.|192\\.168\\.|127\\.|172\\.16\\.)') THEN i2 END AS originating_ip,
  2 AS hop_count, (s1 = 'FAIL' OR s2 = 'FAIL' OR s3 = 'FAIL') AS relay_suspicious,
  (rep <> '' AND split_part(box, '@', 2) <> split_part(rep, '@', 2)) AS reply_mismatch, sender, concat(subject, '   folded') AS subject_line FROM s""".replace("'   folded'", "' folded'"))
def mobile_header_parse(spark, sf):
    raw = mail(spark, sf).selectExpr("email_id", f"{_RAW} AS raw")
    return raw.select("email_id", hx.mobile_headers("raw").alias("h"), hx.header_map("raw")["subject"].alias("subject_line")).select(
        "email_id", "h.*", "subject_line")


# -- domain facts ----------------------------------------------------------

def _domain_dim(spark, sf):
    return table(spark, sf, "supplier").selectExpr(
        "concat('host', CAST(s_suppkey AS STRING), '.com') AS domain",
        "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS registrar",
        "date_sub(DATE'2024-06-01', CAST(s_suppkey * 5 % 400 AS INT)) AS creation_date", "s_suppkey % 4 <> 0 AS has_mx")


_DOM_CTE = """e AS (SELECT c_custkey, concat('User <u@host', CAST(c_custkey % 120 AS INT), '.com>') AS sender, concat('host', CAST(c_custkey % 120 AS INT), '.com') AS domain FROM customer),
s AS (SELECT concat('host', s_suppkey, '.com') AS domain, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS registrar,
  CAST(s_suppkey * 5 % 400 AS INT) AS age, s_suppkey % 4 <> 0 AS has_mx FROM supplier),
j AS (SELECT c_custkey, e.domain, age, has_mx, CASE WHEN s.domain IS NULL THEN NULL WHEN has_mx OR registrar IS NOT NULL THEN 'RESOLVED' ELSE 'PARTIAL_OR_UNAVAILABLE' END AS st FROM e LEFT JOIN s ON e.domain = s.domain)"""


@query("domain_enrichment", f"WITH {_DOM_CTE} SELECT c_custkey, domain, age AS age_days, st AS domain_status, coalesce(age < 30, false) AS is_young_domain FROM j")
def domain_enrichment(spark, sf):
    e = table(spark, sf, "customer").selectExpr("c_custkey", "concat('User <u@host', CAST(c_custkey % 120 AS INT), '.com>') AS sender")
    out = en.enrich_domains(e, _domain_dim(spark, sf), F.to_date(F.lit("2024-06-01")))
    return out.select("c_custkey", "domain", "age_days", "domain_status", "is_young_domain")


@query("domain_risk_signals", f"""
WITH {_DOM_CTE} SELECT c_custkey, CASE WHEN age < 30 THEN 85 WHEN age < 90 THEN 40 ELSE 0 END AS registration_score,
  CASE WHEN NOT coalesce(has_mx, true) AND st = 'RESOLVED' AND len(domain) > 4 THEN 60 ELSE 0 END AS mx_score FROM j""")
def domain_risk_signals(spark, sf):
    e = table(spark, sf, "customer").selectExpr("c_custkey", "concat('User <u@host', CAST(c_custkey % 120 AS INT), '.com>') AS sender")
    out = en.enrich_domains(e, _domain_dim(spark, sf), F.to_date(F.lit("2024-06-01"))).withColumns({
        "sender_imitation": F.lit(False), "url_imitation": F.lit(False)})
    return fusion.domain_signals(out).select("c_custkey", "registration_score", "mx_score")


@query("registry_documents", """
SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE CAST(DATE '2020-01-01' + CAST(s_suppkey AS INT) AS VARCHAR) END AS creation_date,
  CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE greatest(0, date_diff('day', DATE '2020-01-01' + CAST(s_suppkey AS INT), DATE '2024-06-01')) END AS age_days,
  CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN concat('H', s_suppkey) ELSE 'Private / Unlisted' END AS registrar FROM supplier""")
def registry_documents(spark, sf):
    day = "CAST(date_add(DATE'2020-01-01', CAST(s_suppkey AS INT)) AS STRING)"
    events = f"CASE WHEN s_suppkey % 5 = 4 THEN '[]' ELSE concat('[{{\"eventAction\":\"registration\",\"eventDate\":\"', {day}, 'T10:00:00Z\"}}]') END"
    entity = ("CASE s_suppkey % 3 WHEN 0 THEN concat('[{\"roles\":[\"registrar\"],\"handle\":\"X\",\"vcardArray\":[\"vcard\",[[\"version\",{},\"text\",\"4.0\"],[\"fn\",{},\"text\",\"', s_name, '\"]]]}]') "
              "WHEN 1 THEN concat('[{\"roles\":[\"registrar\"],\"handle\":\"H', CAST(s_suppkey AS STRING), '\"}]') ELSE '[]' END")
    doc = table(spark, sf, "supplier").selectExpr("s_suppkey", f"concat('{{\"events\":', {events}, ',\"entities\":', {entity}, '}}') AS doc")
    return doc.select("s_suppkey", en.parse_registry("doc", F.to_date(F.lit("2024-06-01"))).alias("r")).select("s_suppkey", "r.*")


@query("geo_provider_fallback", f"""
WITH {_HOP_ROWS}, i AS (SELECT DISTINCT ip, CAST(split_part(ip, '.', 4) AS INT) AS n FROM hops WHERE ip_class = 'PUBLIC')
SELECT ip, CASE WHEN n % 2 = 0 THEN 'first' WHEN n % 3 = 0 THEN 'second' WHEN n % 5 = 0 THEN 'third' END AS source FROM i""")
def geo_provider_fallback(spark, sf):
    ips = en.relay_hops(mail(spark, sf)).select("ip")
    keyed = ips.filter("ip is not null").distinct().withColumn("n", F.split_part("ip", F.lit("."), F.lit(4)).cast("int"))
    snap = lambda d, name: keyed.filter(F.col("n") % d == 0).select("ip", F.lit(name).alias("source"))
    return en.resolve_geo(ips, [snap(2, "first"), snap(3, "second"), snap(5, "third")])


_ATT = ["a.pdf", "run.exe", "doc.docx", "b.PDF", "x.js", "plain"]
_MIME = ["application/pdf", "application/x-executable", "", "application/octet-stream"]


@query("attachment_checks", f"""
WITH a AS (SELECT doc_id, split_part('{"|".join(_ATT)}', '|', CAST(doc_id % 6 AS INT) + 1) AS fn, split_part('{"|".join(_MIME)}', '|', CAST(doc_id % 4 AS INT) + 1) AS mt,
  sha256(text) AS sha, doc_id % 11 = 0 AS enc FROM documents),
b AS (SELECT *, sha IN (SELECT sha256(text) FROM documents WHERE doc_id % 50 = 7) AS bad FROM a)
SELECT doc_id, bad AS known_bad, greatest(CASE WHEN enc THEN 75 ELSE 0 END, CASE WHEN bad THEN 100 ELSE 0 END,
  CASE WHEN ends_with(lower(fn), '.pdf') AND mt <> '' AND NOT contains(mt, 'pdf') AND NOT contains(mt, 'octet-stream') THEN 85 ELSE 0 END,
  CASE WHEN ends_with(fn, '.exe') OR ends_with(fn, '.js') THEN 90 ELSE 0 END) AS attachment_score FROM b""")
def attachment_checks(spark, sf):
    docs = table(spark, sf, "documents")
    a = docs.selectExpr(
        "doc_id", f"split_part('{'|'.join(_ATT)}', '|', CAST(doc_id % 6 AS INT) + 1) AS filename",
        f"split_part('{'|'.join(_MIME)}', '|', CAST(doc_id % 4 AS INT) + 1) AS content_type", "sha2(text, 256) AS sha256", "doc_id % 11 = 0 AS is_encrypted")
    listed = docs.filter("doc_id % 50 = 7").selectExpr("sha2(text, 256) AS sha256")
    bad = en.known_bad_attachments(a.select("doc_id", "sha256"), listed).select("doc_id").withColumn("known_bad", F.lit(True))
    rated = en.attachment_risk(a.join(bad, "doc_id", "left").withColumn("known_bad", F.coalesce("known_bad", F.lit(False))))
    return rated.select("doc_id", "known_bad", "attachment_score")
