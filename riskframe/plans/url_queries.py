"""Queries over URLs, hosts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.functions import fusion
from riskframe.functions import urls as ux
from riskframe.functions.common import host_of
from riskframe.functions.text import link_mismatches
from riskframe.operators import triage as tr
from riskframe.operators.enrichment import decode_hosts, trusted_hosts
from riskframe.plans.datasets import LINK_SQL, MAIL_SQL, links, mail, table
from riskframe.plans.registry import query
from riskframe.plans.sqltext import ends_any, has_any, in_list, quoted, starts_any, under

_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1))"
_SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def _brand_case(result: str) -> str:
    """First decisive brand as a CASE; ``result`` picks 'brand' or 'type'."""
    parts = []
    for brand, official in lx.PROTECTED_BRANDS:
        pick = (lambda kind: quoted(brand) if result == "brand" else quoted(kind))  # noqa: B023
        parts.append(f"WHEN {under('host', official)} THEN NULL")
        parts.append(f"WHEN contains(root, {quoted(brand)}) THEN {pick('COMBOSQUAT')}")
        if len(brand) >= 4:
            parts.append(f"WHEN len(root) >= 4 AND levenshtein(root, {quoted(brand)}) BETWEEN 1 AND 2 THEN {pick('TYPOSQUAT')}")
        parts.append(f"WHEN sub <> '' AND {has_any('sub', [brand, *official])} THEN {pick('SUBDOMAIN_SPOOF')}")
    return "CASE WHEN nparts < 2 THEN NULL " + " ".join(parts) + " END"


_HOSTS_CTE = f"""
l AS ({LINK_SQL}), h AS (SELECT link_id, url, {_HOST} AS host, {_SCHEME} AS scheme FROM l),
p AS (SELECT *, string_split(host, '.') AS ps, len(string_split(host, '.')) AS nparts FROM h),
r AS (SELECT *, CASE WHEN nparts >= 2 THEN ps[nparts - 1] ELSE '' END AS root,
  CASE WHEN nparts > 2 THEN array_to_string(ps[1:nparts - 2], '.') ELSE '' END AS sub FROM p),
b AS (SELECT *, {_brand_case('brand')} AS brand, {_brand_case('type')} AS imitation FROM r),
a AS (SELECT *, {in_list('host', lx.SHORTENERS)} AS short, {ends_any('host', lx.SUSPICIOUS_TLDS)} AS bad_tld,
  regexp_matches(host, '^\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}$') AS addr,
  ({in_list('host', lx.INTERNAL_HOSTS)} OR {starts_any('host', lx.INTERNAL_PREFIXES)}) AS internal,
  ({under('host', lx.TRUSTED_DOMAINS)} OR {ends_any('host', lx.INSTITUTION_SUFFIXES)}) AS trusted FROM b),
s AS (SELECT *, CASE WHEN {in_list('scheme', lx.DANGEROUS_SCHEMES)} THEN 95 WHEN imitation IS NOT NULL THEN 90
  WHEN internal OR addr THEN 90 WHEN short AND bad_tld THEN 85 WHEN short THEN 75 WHEN bad_tld THEN 70
  WHEN NOT trusted THEN 25 ELSE 0 END AS risk FROM a)"""


@query("url_risk", f"WITH {_HOSTS_CTE} SELECT link_id, host AS domain, short AS is_shortener, trusted AS is_trusted, "
       "bad_tld AS suspicious_tld, addr AS ip_based, imitation IS NOT NULL AS is_brand_impersonation, brand, "
       "imitation AS impersonation_type, risk AS risk_score FROM s")
def url_risk(spark, sf):
    return links(spark, sf).select("link_id", ux.url_assessment("url").alias("a")).select("link_id", "a.*")


@query("url_rollup", f"WITH {_HOSTS_CTE} SELECT link_id % 1000000000 AS message_id, max(risk) AS url_risk, bool_or(short) AS any_shortener, "
       "bool_or(bad_tld) AS any_bad_tld, bool_or(addr) AS any_ip, bool_or(imitation IS NOT NULL) AS any_imitation, count(*) AS n_urls "
       "FROM s GROUP BY 1")
def url_rollup(spark, sf):
    grouped = links(spark, sf).select((F.col("link_id") % 1000000000).alias("message_id"), ux.url_assessment("url").alias("a"))
    return tr.url_rollup(grouped.select("message_id", "a.*"), "message_id")


@query("brand_imitation", f"WITH {_HOSTS_CTE} SELECT host, any_value(brand) AS brand, any_value(imitation) AS imitation FROM b WHERE imitation IS NOT NULL GROUP BY host")
def brand_imitation(spark, sf):
    hosts = links(spark, sf).select(host_of(F.col("url")).alias("host")).distinct()
    out = hosts.withColumn("o", ux.brand_imitation("host")).filter(F.col("o").isNotNull())
    return out.select("host", F.col("o.brand").alias("brand"), F.col("o.type").alias("imitation"))


@query("trusted_hosts", f"WITH {_HOSTS_CTE} SELECT host, any_value({under('host', lx.MOBILE_TRUSTED_HOSTS)}) AS is_trusted FROM h GROUP BY host")
def trusted_host_match(spark, sf):
    hosts = links(spark, sf).select(host_of(F.col("url")).alias("host")).distinct()
    dim = spark.createDataFrame([(d,) for d in lx.MOBILE_TRUSTED_HOSTS], "domain string")
    return trusted_hosts(hosts, dim)


def _reg(host: str) -> str:
    two = f"array_to_string(string_split({host}, '.')[-2:], '.')"
    n = f"len(string_split({host}, '.'))"
    keep = f"CASE WHEN {n} >= 3 AND {in_list(two, lx.TWO_LEVEL_SUFFIXES)} THEN 3 ELSE 2 END"
    return (f"CASE WHEN {n} <= 2 THEN {host} ELSE array_to_string(string_split({host}, '.')[{n} - ({keep}) + 1:], '.') END",
            f"CASE WHEN {n} <= 2 THEN '' ELSE array_to_string(string_split({host}, '.')[1:{n} - ({keep})], '.') END")


_LONG_BRANDS = [b for b in lx.MOBILE_BRANDS if len(b) >= 4]
_NEAR = " OR ".join(f"(label <> {quoted(b)} AND levenshtein(label, {quoted(b)}) BETWEEN 1 AND 2)" for b in _LONG_BRANDS)


@query("mobile_domain_spoof", f"""
WITH {_HOSTS_CTE}, d AS (SELECT DISTINCT host FROM h WHERE host <> ''),
g AS (SELECT host, {_reg('host')[0]} AS root, {_reg('host')[1]} AS prefix FROM d),
k AS (SELECT *, split_part(root, '.', 1) AS label FROM g)
SELECT host, root, (NOT {in_list('root', lx.OFFICIAL_ROOTS)} AND ((len(label) >= 4 AND ({_NEAR})) OR
  (prefix <> '' AND {has_any('prefix', lx.MOBILE_BRANDS)}))) AS typosquat, false AS homograph FROM k""")
def mobile_domain_spoof(spark, sf):
    hosts = links(spark, sf).select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    decoded = decode_hosts(hosts)
    return decoded.select("host", ux.registrable(F.col("host"))["root"].alias("root"),
                          ux.domain_spoof("host", F.col("unicode_host")).alias("s")).select("host", "root", "s.*")


# -- lexical features ------------------------------------------------------

_NETLOC = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def _entropy(c: str) -> str:
    return (f"CASE WHEN {c} = '' THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split({c}, '')), lambda ch: "
            f"-((len({c}) - len(replace({c}, ch, '')))::DOUBLE / len({c})) * log2((len({c}) - len(replace({c}, ch, '')))::DOUBLE / len({c})))) END")


def _count(c: str, ch: str) -> str:
    return f"(len({c}) - len(replace({c}, {quoted(ch)}, '')))"


_FEATURES = {
    "url_length": "len(url)", "domain_length": "len(dom)", "path_length": f"len({_PATH})",
    "count_dots": _count("url", "."), "count_hyphens": _count("url", "-"), "count_underscores": _count("url", "_"),
    "count_at": _count("url", "@"), "count_percent": _count("url", "%"), "count_query_marks": _count("url", "?"),
    "count_ampersand": _count("url", "&"), "count_equal": _count("url", "="),
    "count_digits": "len(regexp_extract_all(url, '\\p{Nd}'))", "count_letters": "len(regexp_extract_all(url, '\\p{L}'))",
    "count_subdomains": _count("dom", "."),
    "digit_ratio": "len(regexp_extract_all(url, '\\p{Nd}')) / (len(url) + 1)",
    "letter_ratio": "len(regexp_extract_all(url, '\\p{L}')) / (len(url) + 1)",
    "has_ip": "CAST(regexp_matches(dom, '^\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}$') AS INT)", "has_at": "CAST(contains(url, '@') AS INT)",
    "has_https": "CAST(starts_with(lower(url), 'https:') AS INT)",
    "has_tinyurl": f"CAST({has_any('url', lx.FEATURE_SHORTENERS)} AS INT)",
    "has_prefix_suffix": "CAST(contains(dom, '-') AS INT)", "has_punycode": "CAST(contains(dom, 'xn--') AS INT)",
    "url_entropy": f"round({_entropy('url')}, 6)", "domain_entropy": f"round({_entropy('dom')}, 6)",
    "is_suspicious_tld": f"CAST({in_list('string_split(dom, chr(46))[-1]', lx.FEATURE_TLDS)} AS INT)",
    "has_brand_name": f"CAST({has_any('lower(url)', lx.FEATURE_BRANDS)} AS INT)",
    "count_non_alphanumeric": "len(regexp_extract_all(url, '[^\\p{L}\\p{N}]'))",
    "is_encoded": "CAST(contains(url, '%') AS INT)",
    "double_slash_redirection": "CAST(regexp_matches(url, '^.{8,}//') AS INT)",
}
_FEAT_SQL = ", ".join(f"{e} AS {n}" for n, e in _FEATURES.items())
_FEAT_CTE = f"f AS (SELECT link_id, url, {_FEAT_SQL} FROM (SELECT link_id, url, {_NETLOC} AS dom FROM ({LINK_SQL})))"


def _features(spark, sf):
    feats = ux.lexical_features("url")
    return links(spark, sf).select("link_id", "url", *[
        (F.round(c, 6) if n.endswith("entropy") else c).alias(n) for n, c in feats.items()])


@query("url_lexical_features", f"WITH {_FEAT_CTE} SELECT * EXCLUDE (url) FROM f")
def url_lexical_features(spark, sf):
    return _features(spark, sf).drop("url")


_SCORE = ("least(1.0, CASE WHEN is_suspicious_tld = 1 THEN 0.4 ELSE 0 END + CASE WHEN has_ip = 1 THEN 0.5 ELSE 0 END "
          "+ CASE WHEN url_length > 75 THEN 0.2 ELSE 0 END + CASE WHEN digit_ratio > 0.3 THEN 0.3 ELSE 0 END "
          "+ CASE WHEN domain_entropy > 4.0 THEN 0.3 ELSE 0 END + CASE WHEN has_brand_name = 1 AND has_https = 0 THEN 0.4 ELSE 0 END)")


@query("url_heuristic_score", f"""
WITH {_FEAT_CTE}, g AS (SELECT link_id, url, has_ip, has_brand_name, has_https, CAST({_SCORE} AS DOUBLE) AS score FROM f),
o AS (SELECT link_id, score, CASE WHEN has_brand_name = 1 AND has_https = 0 AND NOT {has_any('lower(url)', lx.OVERRIDE_SAFE_HOSTS)}
  THEN greatest(CASE WHEN has_ip = 1 THEN greatest(score, 0.96) ELSE score END, 0.75)
  ELSE CASE WHEN has_ip = 1 THEN greatest(score, 0.96) ELSE score END END AS probability FROM g)
SELECT link_id, round(score, 6) AS score, round(probability, 6) AS probability, CASE WHEN probability > 0.85 THEN 'DANGEROUS' WHEN probability > 0.45 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS label FROM o""")
def url_heuristic_score(spark, sf):
    scored = _features(spark, sf).withColumn("score", ux.heuristic_url_score())
    scored = scored.withColumn("probability", ux.overridden_probability(F.col("score"), "url"))
    return scored.select("link_id", F.round("score", 6).alias("score"), F.round("probability", 6).alias("probability"),
                         ux.probability_label(F.col("probability")).alias("label"))


_MOBILE_HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)"
_MPATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query("mobile_url_features", f"""
SELECT link_id, len(url) AS url_length, len(h) AS domain_length, len(regexp_extract_all(url, '\\p{{Nd}}')) AS qty_digits,
  {_count('url', '.')} AS qty_dots, {_count('url', '-')} AS qty_hyphens, CAST(starts_with(lower(url), 'https') AS INT) AS has_https,
  greatest(len(string_split(h, '.')) - 2, 0) AS qty_subdomains, round({_entropy('url')}, 6) AS url_entropy,
  CAST({has_any('lower(url)', lx.MOBILE_URL_KEYWORDS)} AS INT) AS has_suspicious_keyword,
  len(regexp_extract_all(url, '[^\\p{{L}}\\p{{Nd}}/:.?=]')) AS qty_special_chars,
  len(list_filter(string_split({_MPATH}, '/'), lambda x: x <> '')) AS url_depth,
  CAST(regexp_matches(h, '^\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}$') AS INT) AS is_ip,
  CAST({ends_any('h', lx.MOBILE_URL_TLDS)} AS INT) AS is_suspicious_tld,
  len(regexp_extract(url, '\\?([^#]*)', 1)) AS query_length
FROM (SELECT link_id, url, {_MOBILE_HOST} AS h FROM ({LINK_SQL}))""")
def mobile_url_features(spark, sf):
    feats = ux.mobile_features("url")
    return links(spark, sf).select("link_id", *[(F.round(c, 6) if n == "url_entropy" else c).alias(n) for n, c in feats.items()])


@query("url_codes", f"""
SELECT link_id, array_to_string(list_transform(range(1, 201), lambda i: CASE WHEN i <= len(url)
  THEN least(127, greatest(1, unicode(substr(lower(url), i, 1)))) ELSE 0 END), ',') AS codes FROM ({LINK_SQL})""")
def url_codes(spark, sf):
    return links(spark, sf).select("link_id", F.array_join(F.transform(
        ux.url_codes("url"), lambda x: x.cast("string")), ",").alias("codes"))


@query("domain_cleanup", f"""
WITH m AS (SELECT email_id, lower(trim(sender)) AS s FROM ({MAIL_SQL})),
d AS (SELECT email_id, CASE WHEN contains(s, '@') THEN trim(trim(string_split(s, '@')[-1], '>')) ELSE s END AS t FROM m)
SELECT email_id, CASE WHEN contains(t, '.') AND len(t) >= 4 THEN t ELSE '' END AS domain FROM d""")
def domain_cleanup(spark, sf):
    return mail(spark, sf).select("email_id", ux.clean_domain("sender").alias("domain"))


@query("link_text_mismatch", r"""
WITH h AS (SELECT page_id, concat(html, CASE WHEN page_id % 3 = 0 THEN '<a href="http://evil.example.net/x">https://bank.example.com/</a>' ELSE '' END) AS h FROM pages),
a AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<a[^>]+href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)) AS href,
  unnest(regexp_extract_all(h, '(?is)<a[^>]+href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 2)) AS shown FROM h),
t AS (SELECT page_id, lower(regexp_extract(href, '^[A-Za-z]+://([^/:?#]*)', 1)) AS th,
  trim(regexp_replace(shown, '<[^>]+>', '', 'g')) AS s FROM a),
c AS (SELECT page_id, count_if(regexp_matches(s, '(?i)^https?://') AND th <> '' AND lower(regexp_extract(s, '^[A-Za-z]+://([^/:?#]*)', 1)) NOT IN ('', th)) AS n FROM t GROUP BY 1)
SELECT pages.page_id, CAST(coalesce(n, 0) AS INT) AS mismatches FROM pages LEFT JOIN c ON pages.page_id = c.page_id""")
def link_text_mismatch(spark, sf):
    fake = F.lit('<a href="http://evil.example.net/x">https://bank.example.com/</a>')
    html = F.concat("html", F.when(F.col("page_id") % 3 == 0, fake).otherwise(""))
    return table(spark, sf, "pages").select("page_id", link_mismatches(html).alias("mismatches"))


@query("dangerous_targets", f"""
SELECT link_id, {ends_any("split_part(split_part(lower(rtrim(u, '.,;:)]}>' || chr(34) || chr(39))), '?', 1), '#', 1)", lx.DANGEROUS_TARGET_EXTENSIONS)} AS dangerous
FROM (SELECT link_id, concat(url, CASE link_id % 5 WHEN 0 THEN '/run.exe?x=1' WHEN 1 THEN '/a.application);' WHEN 2 THEN '/readme.txt' ELSE '' END) AS u FROM ({LINK_SQL}))""")
def dangerous_targets(spark, sf):
    tail = F.expr("CASE link_id % 5 WHEN 0 THEN '/run.exe?x=1' WHEN 1 THEN '/a.application);' WHEN 2 THEN '/readme.txt' ELSE '' END")
    return links(spark, sf).select("link_id", ux.dangerous_target(F.concat("url", tail)).alias("dangerous"))


# -- sender checks ---------------------------------------------------------

def _spoof_sql() -> str:
    brands = [d.split(".")[0] for d in lx.TRUSTED_DOMAINS]
    lst = "[" + ", ".join(quoted(b) for b in brands) + "]"
    dom = lambda c: f"string_split(regexp_extract(lower({c}), '[\\w.\\-+]+@[\\w.\\-]+\\.\\w+'), '@')[-1]"
    return f"""
WITH m AS (SELECT email_id, sender, {dom('sender')} AS fd, {dom('reply_to')} AS rd, {dom('return_path')} AS bd,
  lower(regexp_extract(sender, '^"?(.+?)"?\\s*<(.+?)>', 1)) AS disp, lower(regexp_extract(sender, '^"?(.+?)"?\\s*<(.+?)>', 2)) AS box FROM ({MAIL_SQL})),
p AS (SELECT *, CASE WHEN contains(box, '@') THEN string_split(box, '@')[-1] ELSE '' END AS ed, split_part(box, '@', 1) AS lp,
  replace(replace(translate(fd, '10', 'lo'), 'rn', 'm'), 'vv', 'w') AS nf FROM m),
t AS (SELECT *, disp <> '' AND len(list_filter({lst}, lambda b: contains(disp, b) AND NOT contains(ed, b))) > 0 AS claim,
  disp <> '' AND {in_list('ed', lx.FREEMAIL_DOMAINS)} AND len(list_filter({lst}, lambda b: contains(lp, b))) > 0 AS free,
  fd <> '' AND len(list_filter({lst}, lambda b: contains(nf, b) AND NOT contains(fd, b))) > 0 AS alike,
  (fd <> '' AND rd <> '' AND rd <> fd) OR (fd <> '' AND bd <> '' AND bd <> fd) AS mismatch,
  CASE WHEN disp <> '' THEN len(list_filter({lst}, lambda b: contains(disp, b) AND NOT contains(ed, b))) ELSE 0 END
  + CASE WHEN disp <> '' AND {in_list('ed', lx.FREEMAIL_DOMAINS)} THEN len(list_filter({lst}, lambda b: contains(lp, b))) ELSE 0 END
  + CASE WHEN fd <> '' THEN len(list_filter({lst}, lambda b: contains(nf, b) AND NOT contains(fd, b))) ELSE 0 END
  + CAST(fd <> '' AND rd <> '' AND rd <> fd AS INT) + CAST(fd <> '' AND bd <> '' AND bd <> fd AS INT) AS nfac FROM p)
SELECT email_id, greatest(CASE WHEN alike THEN 85 ELSE 0 END, CASE WHEN free THEN 80 ELSE 0 END, CASE WHEN claim THEN 75 ELSE 0 END,
  CASE WHEN mismatch THEN 65 ELSE 0 END) AS score, mismatch AS header_mismatch, alike AS lookalike, (claim OR free) AS impersonating,
  CAST(nfac AS INT) AS n_factors FROM t"""


@query("sender_spoofing", _spoof_sql())
def sender_spoofing(spark, sf):
    return mail(spark, sf).select("email_id", ux.spoof_check("sender", "reply_to", "return_path").alias("s")).select(
        "email_id", "s.score", "s.header_mismatch", "s.lookalike", "s.impersonating", F.size("s.factors").alias("n_factors"))


_DISPLAY = " ".join(
    f"WHEN contains(d, {quoted(b)}) AND NOT contains(e, {quoted(b)}) THEN {quoted(b)}" for b in lx.DISPLAY_NAME_BRANDS)


@query("display_name_spoof", f"""
SELECT email_id, CASE WHEN NOT (contains(sender, '<') AND contains(sender, '>')) THEN NULL {_DISPLAY} END AS spoofed_brand
FROM (SELECT email_id, sender, lower(trim(split_part(sender, '<', 1))) AS d, lower(trim(regexp_extract(sender, '<([^>]*)>', 1))) AS e FROM ({MAIL_SQL}))""")
def display_name_spoof(spark, sf):
    return mail(spark, sf).select("email_id", ux.display_spoof("sender").alias("spoofed_brand"))


_DOWN = ["photo.jpg.apk", "setup.exe", "report.pdf", "scan.png", "invoice.doc.js", "noext", "archive.tar.gz", "movie.mp4"]


@query("download_metadata_score", """
WITH d AS (SELECT p_partkey, split_part('""" + "|".join(_DOWN) + """', '|', CAST(p_partkey % 8 AS INT) + 1) AS f,
  p_size * 1048576 AS size, CAST(p_partkey * 7 % 101 AS INT) AS ml FROM part),
m AS (SELECT p_partkey, ml, regexp_matches(f, '\\.[a-z0-9]{2,4}\\.(apk|exe|vbs|bat|cmd|js|ps1|scr|jar)$') AS dbl,
  CASE WHEN contains(f, '.') THEN string_split(f, '.')[-1] ELSE '' END AS ext, f, size FROM d),
s AS (SELECT *, least(100, CASE WHEN dbl THEN 50 ELSE 0 END + CASE WHEN '.' || ext IN ('.exe','.apk','.vbs','.scr','.bat','.cmd','.js','.ps1','.jar','.dex','.dll','.hta') THEN 30 ELSE 0 END
  + CASE WHEN regexp_matches(f, '\\.(jpg|png|jpeg)$') AND size > 26214400 THEN 35 ELSE 0 END) AS meta FROM m),
b AS (SELECT *, CAST(floor(meta * 0.5 + ml * 0.5) AS INT) AS bl, (meta >= 40 AND ml >= 40) OR (dbl AND ext = 'apk') AS ok FROM s)
SELECT p_partkey, meta AS metadata_score, CASE WHEN ok THEN bl ELSE least(bl, 59) END AS pre_score,
  CASE WHEN CASE WHEN ok THEN bl ELSE least(bl, 59) END >= 60 THEN 'MALICIOUS' WHEN CASE WHEN ok THEN bl ELSE least(bl, 59) END >= 20 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict FROM b""")
def download_metadata_score(spark, sf):
    names = "|".join(_DOWN)
    df = table(spark, sf, "part").selectExpr(
        "p_partkey", f"split_part('{names}', '|', CAST(p_partkey % 8 AS INT) + 1) AS file_name",
        "p_size * 1048576 AS declared_size", "CAST(p_partkey * 7 % 101 AS INT) AS url_ml_score")
    return fusion.download_score(df).select("p_partkey", "metadata_score", "pre_score", "verdict")
