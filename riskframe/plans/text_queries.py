"""Queries over message text."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.functions import fusion
from riskframe.functions import text as tx
from riskframe.functions import urls as ux
from riskframe.operators import triage as tr
from riskframe.operators.language import build_vocabulary, detect_romanised, encode_tokens
from riskframe.operators.joins import lookup_join
from riskframe.plans import header_queries, url_queries  # noqa: F401  (their queries' SQL is used below)
from riskframe.plans.datasets import LINK_SQL, MAIL_SQL, mail, table
from riskframe.plans.registry import QUERIES, query
from riskframe.plans.sqltext import (
    ends_any, has_any, hit_count, hit_list, in_list, matches, quoted, under, unicode_edges,
)
from riskframe.session import checkpointed

EMAIL_RE = tx.EMAIL_PATTERN
PHONE_RE = tx.PHONE_PATTERN


# -- redaction and extraction ----------------------------------------------

_PII = [
    (r"\b([A-Za-z0-9._%+-]{1})[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})\b", r"\1***@\2"),
    (r"\b(?:\+\d{1,3}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b", "[REDACTED_PHONE]"),
    (r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", "[REDACTED_CARD]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
]


def _replaced(expr: str, rules) -> str:
    for pattern, mask in rules:
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(mask)}, 'g')"
    return expr


@query("redact_pii", f"SELECT doc_id, sha256({_replaced('text', _PII)}) AS redacted_hash, "
       f"len({_replaced('text', _PII)}) AS redacted_length FROM documents")
def redact_pii(spark, sf):
    out = table(spark, sf, "documents").select("doc_id", tx.redact_pii("text").alias("r"))
    return out.select("doc_id", F.sha2("r", 256).alias("redacted_hash"), F.length("r").cast("bigint").alias("redacted_length"))


_CODES = [(r"\b\d{4,8}\b", "[REDACTED_OTP]"), (r"(?i)(password|pin|cvv|code)\s*[:=]\s*\S+", r"\1: [REDACTED]")]
_CONTACT = [(EMAIL_RE, "[REDACTED_EMAIL]"), (PHONE_RE, "[REDACTED_PHONE]"),
            (r"(?i)\b[a-zA-Z0-9.\-_]{2,256}@[a-zA-Z]{2,64}\b", "[REDACTED_UPI]")]


@query("redact_outbound", f"SELECT email_id, sha256({_replaced('body_text', _CODES)}) AS codes_hash, "
       f"sha256({_replaced('body_text', _CONTACT)}) AS contact_hash FROM ({MAIL_SQL})")
def redact_outbound(spark, sf):
    return mail(spark, sf).select(
        "email_id", F.sha2(tx.redact_codes("body_text"), 256).alias("codes_hash"),
        F.sha2(tx.redact_contact("body_text"), 256).alias("contact_hash"))


_SPLIT_MASK = """CASE WHEN contains({c}, '@') THEN concat(
  CASE WHEN len(split_part({c}, '@', 1)) > 1 THEN concat(left({c}, 1), '***') ELSE '***' END, '@', split_part({c}, '@', 2))
  ELSE {c} END"""
_NORM = """CASE WHEN contains(trim(v), '@') THEN lower(trim(v))
  WHEN len(regexp_replace(v, '[^0-9]', '', 'g')) >= 10 THEN right(regexp_replace(v, '[^0-9]', '', 'g'), 10)
  ELSE lower(trim(v)) END"""


@query("sender_masking", f"""
SELECT email_id, {_SPLIT_MASK.format(c='sender')} AS masked, lower(trim(sender)) AS normalized,
  concat('E-', CAST(email_id AS VARCHAR)) AS case_id, true AS valid_id,
  sha256(concat(sender, ':', subject, ':', '2024-01-01')) AS evidence_hash,
  {_NORM.replace('v', "concat('+91 (', CAST(email_id % 900 + 100 AS VARCHAR), ') 555-', CAST(email_id % 9000 + 1000 AS VARCHAR))")} AS phone_key
FROM ({MAIL_SQL})""")
def sender_masking(spark, sf):
    phone = F.expr("concat('+91 (', CAST(email_id % 900 + 100 AS STRING), ') 555-', CAST(email_id % 9000 + 1000 AS STRING))")
    return mail(spark, sf).withColumn("case_id", F.concat(F.lit("E-"), F.col("email_id").cast("string"))).select(
        "email_id", tx.mask_email("sender").alias("masked"), tx.normalize_sender("sender").alias("normalized"),
        "case_id", tx.valid_case_id("case_id").alias("valid_id"),
        tx.evidence_hash("sender", "subject", F.lit("2024-01-01")).alias("evidence_hash"),
        tx.normalize_sender(phone).alias("phone_key"))


@query("extract_contacts", f"""
SELECT doc_id, list_aggregate(list_sort(list_distinct(regexp_extract_all(text, {quoted(PHONE_RE)}))), 'string_agg', ' ; ') AS phones,
  list_aggregate(list_sort(list_distinct(list_transform(regexp_extract_all(text, {quoted(EMAIL_RE)}), lambda e: lower(e)))), 'string_agg', ' ; ') AS emails
FROM documents
WHERE regexp_matches(text, {quoted(PHONE_RE)}) OR regexp_matches(text, {quoted(EMAIL_RE)})""")
def extract_contacts(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", tx.extract_phones("text").alias("p"), tx.extract_emails("text").alias("e"))
    join = lambda c: F.when(F.size(c) > 0, F.array_join(F.array_sort(c), " ; "))
    return docs.filter((F.size("p") > 0) | (F.size("e") > 0)).select("doc_id", join("p").alias("phones"), join("e").alias("emails"))


@query("extract_urls", f"""
WITH m AS ({MAIL_SQL}),
u AS (SELECT email_id, list_distinct(list_transform(regexp_extract_all(body_text, {quoted(tx.URL_PATTERN)}), lambda x: rtrim(x, '.'))) AS l,
  list_distinct(list_transform(regexp_extract_all(body_text, {quoted(tx.MESSAGE_URL_PATTERN)}), lambda x: rtrim(x, '.,;'))) AS q FROM m)
SELECT email_id, CAST(len(l) AS INT) AS n_urls, list_aggregate(list_sort(l), 'string_agg', ' ') AS urls,
  list_aggregate(list_sort(q), 'string_agg', ' ') AS message_urls FROM u WHERE len(l) > 0""")
def extract_urls(spark, sf):
    u = mail(spark, sf).select("email_id", tx.extract_urls("body_text").alias("l"), tx.extract_message_urls("body_text").alias("q"))
    return u.filter(F.size("l") > 0).select(
        "email_id", F.size("l").alias("n_urls"), F.array_join(F.array_sort("l"), " ").alias("urls"),
        F.array_join(F.array_sort("q"), " ").alias("message_urls"))


# -- signal groups and exposure --------------------------------------------

_SIG = {
    "urgency": matches("t", unicode_edges(lx.URGENCY_PATTERN)), "action": matches("t", unicode_edges(lx.ACTION_PATTERN)),
    "credential": f"({matches('t', unicode_edges(lx.CREDENTIAL_REQUEST_PATTERN))} AND NOT {matches('t', unicode_edges(lx.SAFETY_ADVICE_PATTERN))} "
                  f"AND NOT {matches('t', unicode_edges(lx.INFORMATIONAL_PATTERN))})",
    "money_lure": matches("t", unicode_edges(lx.MONEY_LURE_PATTERN)), "callback": matches("t", unicode_edges(lx.CALLBACK_PATTERN)),
}
_SIG_SQL = ", ".join(f"{e} AS {n}" for n, e in _SIG.items())
_SIG_SUM = " + ".join(f"CAST({n} AS INT)" for n in _SIG)
_EXPOSED = "list_filter([" + ", ".join(
    f"CASE WHEN {matches('t', '(?i)' + p)} THEN {quoted(label)} END" for label, p in lx.EXPOSURE_PATTERNS) + "], lambda x: x IS NOT NULL)"


@query("text_signals", f"""
SELECT email_id, urgency, action, credential, money_lure, callback, {_SIG_SUM} AS n_signals,
  CASE WHEN {_SIG_SUM} >= 3 THEN 'HIGH' WHEN {_SIG_SUM} = 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
FROM (SELECT email_id, {_SIG_SQL} FROM (SELECT email_id, body_text AS t FROM ({MAIL_SQL})))""")
def text_signals(spark, sf):
    s = mail(spark, sf).select("email_id", tx.text_signals("body_text").alias("s"))
    n = tx.signal_count(F.col("s"))
    return s.select("email_id", "s.*", n.alias("n_signals"), tx.signal_confidence(n).alias("confidence"))


_EXPOSURE_ROWS = " UNION ALL ".join(
    f"SELECT email_id, {quoted(label)} AS type, unnest(regexp_extract_all(body_text, {quoted('(?i)' + p)})) AS m FROM m"
    for label, p in lx.EXPOSURE_PATTERNS)


@query("credential_exposure", f"""
WITH m AS ({MAIL_SQL}), x AS ({_EXPOSURE_ROWS})
SELECT email_id, type, regexp_replace(m, '([:=]\\s*)(\\S\\S)(\\S+)', '\\1\\2***', 'g') AS masked, count(*) AS n
FROM x GROUP BY ALL""")
def credential_exposure(spark, sf):
    found = mail(spark, sf).select("email_id", F.inline(tx.exposure_findings("body_text")))
    return found.groupBy("email_id", "type", "masked").agg(F.count(F.lit(1)).alias("n"))


@query("phrase_hits", f"""
SELECT email_id, list_name, phrase FROM (
  SELECT email_id, 'URGENCY' AS list_name, unnest({hit_list('t', lx.URGENCY_PHRASES)}) AS phrase FROM b
  UNION ALL SELECT email_id, 'CREDENTIAL', unnest({hit_list('t', lx.CREDENTIAL_PHRASES)}) FROM b
  UNION ALL SELECT email_id, 'BEC', unnest({hit_list('t', lx.BEC_PHRASES)}) FROM b
  UNION ALL SELECT email_id, 'FRAUD', unnest({hit_list('t', lx.FRAUD_PHRASES)}) FROM b)""".replace(
    "FROM b", f"FROM (SELECT email_id, lower(concat(subject, ' ', body_text)) AS t FROM ({MAIL_SQL}))"))
def phrase_hits(spark, sf):
    lower = mail(spark, sf).select("email_id", F.lower(F.concat_ws(" ", "subject", "body_text")).alias("t"))
    def named(kind):
        return F.transform(tx.phrase_hits(F.col("t"), kind), lambda p: F.struct(
            F.lit(kind).alias("list_name"), p.alias("phrase")))

    rows = F.concat(*[named(k) for k in lx.PHRASE_LISTS])
    return lower.select("email_id", F.inline(rows))


@query("content_gates", f"""
SELECT email_id, (len(trim(body_text)) >= 30 AND NOT {has_any('lower(body_text)', lx.UI_NOISE_TERMS)}) AS analysable,
  (len(trim(subject)) >= 15 AND len(list_filter(string_split_regex(subject, '\\s+'), lambda w: w <> '')) >= 3) AS meaningful,
  (body_text <> '' OR authentication_results <> '') AS full_payload
FROM ({MAIL_SQL})""")
def content_gates(spark, sf):
    return mail(spark, sf).select(
        "email_id", tx.analysable("body_text").alias("analysable"), tx.meaningful("subject").alias("meaningful"),
        ((F.col("body_text") != "") | (F.col("authentication_results") != "")).alias("full_payload"))


# -- context guards and payment links --------------------------------------

_BANK = (f"({hit_count('t', lx.BANK_TERMS)} >= 2 OR ((regexp_matches(t, 'rs\\.?\\s*\\d') OR regexp_matches(t, 'inr\\s*\\d')) "
         f"AND len(regexp_extract_all(t, '\\b\\d{{4,}}\\b')) >= 2))")
_STRUCTURED = (f"({hit_count('t', lx.AGRICULTURE_TERMS)} >= 2 OR {has_any('t', lx.SPREADSHEET_TERMS)} "
               f"OR len(regexp_extract_all(t, '\\b\\d+(?:\\.\\d+)?\\b')) >= 8)")


@query("context_guards", f"""
SELECT email_id, {hit_count('t', lx.ACADEMIC_TERMS)} >= 2 AS academic, {_STRUCTURED} AS structured, {_BANK} AS bank,
  {hit_count('t', lx.RETAILER_TERMS)} >= 2 AS retailer,
  CASE WHEN contains(t, 'upi://pay') AND (contains(t, 'mode=collect') OR regexp_matches(t, '\\bcollect\\b')) THEN 95
       WHEN contains(t, 'upi://pay') THEN 40 ELSE 0 END AS payment_link_score
FROM (SELECT email_id, lower(body_text) AS t FROM ({MAIL_SQL}))""")
def context_guards(spark, sf):
    lower = mail(spark, sf).select("email_id", F.lower("body_text").alias("t"))
    return lower.select("email_id", tx.context_guards(F.col("t")).alias("g"), tx.payment_link_score("t").alias(
        "payment_link_score")).select("email_id", "g.*", "payment_link_score")


# -- forwarding ------------------------------------------------------------

_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_MARK = "(?is)^(.*?)(?:" + "{p}" + ")(.*)$"
_MARKERS = [p.replace("(?i)", "") for p in tx.FORWARD_MARKERS]


def _fwd_cte() -> str:
    tests = " ".join(
        f"WHEN regexp_matches(b, {quoted('(?i)' + p)}) THEN {i}" for i, p in enumerate(_MARKERS, 1))
    before = " ".join(f"WHEN {i} THEN regexp_extract(b, {quoted(_MARK.replace('{p}', p))}, 1)" for i, p in enumerate(_MARKERS, 1))
    after = " ".join(f"WHEN {i} THEN regexp_extract(b, {quoted(_MARK.replace('{p}', p))}, 2)" for i, p in enumerate(_MARKERS, 1))
    block = r"(?is)^(.*?)((?:^|\n)\s*From:\s*[^\n]+\n\s*Date:\s*[^\n]+.*)$"
    return f"""
m AS (SELECT email_id, body_text AS b, subject, regexp_matches(subject, '(?i)^(?:fwd?|fw):\\s*') AS fwd FROM ({MAIL_SQL})),
k AS (SELECT *, CASE {tests} ELSE 0 END AS mk,
  fwd AND regexp_matches(b, '(?i)(?:^|\\n)\\s*From:\\s*[^\\n]+\\n\\s*Date:\\s*[^\\n]+') AS blk FROM m),
s AS (SELECT *, CASE mk {before} ELSE CASE WHEN blk THEN regexp_extract(b, {quoted(block)}, 1) WHEN fwd THEN b ELSE '' END END AS com,
  CASE mk {after} ELSE CASE WHEN blk THEN regexp_extract(b, {quoted(block)}, 2) ELSE b END END AS org FROM k),
h AS (SELECT *, trim(com, {_WS}) AS c, trim(org, {_WS}) AS o, (mk > 0 OR blk) AS q FROM s),
f AS (SELECT *, CASE WHEN q THEN nullif(trim(regexp_extract(o, '(?i)From:\\s*([^\\n]+)', 1), {_WS}), '') END AS frm,
  CASE WHEN q THEN nullif(trim(regexp_extract(o, '(?i)Subject:\\s*([^\\n]+)', 1), {_WS}), '') END AS osub FROM h)"""


def _fwd_sql() -> str:
    return f"""WITH {_fwd_cte()}
SELECT email_id, (q OR fwd) AS is_forwarded,
  CASE WHEN q AND contains(frm, '@') THEN 'ORIGINAL HEADER EVIDENCE AVAILABLE' WHEN q THEN 'PARTIAL ORIGINAL EVIDENCE'
       WHEN fwd THEN 'FORWARDER-ONLY EVIDENCE' ELSE 'ORIGINAL SOURCE UNDETERMINABLE' END AS evidence_level,
  frm AS original_sender, osub AS original_subject,
  sha256(c) AS commentary_hash, sha256(o) AS content_hash FROM f"""


@query("forwarding", _fwd_sql())
def forwarding(spark, sf):
    return mail(spark, sf).select("email_id", tx.forwarding("body_text", "subject").alias("f")).select(
        "email_id", "f.is_forwarded", "f.evidence_level", "f.original_sender", "f.original_subject",
        F.sha2("f.forwarder_commentary", 256).alias("commentary_hash"), F.sha2("f.original_content", 256).alias("content_hash"))


# -- language --------------------------------------------------------------

@query("script_detection", r"""
SELECT conv_id, turn, regexp_matches(text, '[\x{0B80}-\x{0BFF}]') AS tamil, regexp_matches(text, '[\x{0900}-\x{097F}]') AS devanagari,
  regexp_matches(text, '[\x{0C00}-\x{0C7F}]') AS telugu, sha256(trim(regexp_replace(regexp_replace(lower(text), 'http\S+', '<url>', 'g'),
  '[^a-z0-9\s<>\x{0B80}-\x{0BFF}]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) AS clean_hash
FROM conversations""")
def script_detection(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.has_tamil("text").alias("tamil"), tx.has_devanagari("text").alias("devanagari"),
        tx.has_telugu("text").alias("telugu"), F.sha2(tx.clean_for_model("text"), 256).alias("clean_hash"))


@query("romanised_language")
def romanised_language(spark, sf):
    words = ["vangi kanakku block aagum", "plain text here", "turant verify karein khata", "paisa jeeta hai", "hello friend"]
    text = F.concat_ws(" ", "text", F.expr(f"split_part('{'|'.join(words)}', '|', CAST(conv_id % 5 AS INT) + 1)"))
    df = table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("msg_id"), text.alias("text"))
    out = detect_romanised(df, "msg_id")
    return out.select(
        "msg_id", "tanglish_indicators", "hinglish_phrases", "hinglish_words", "tanglish", "hinglish",
        tx.regional_score("text", F.col("tanglish"), F.col("hinglish")).alias("regional_score"))


_GARBLE = f"""
WITH d AS (SELECT doc_id, trim(text, {_WS}) AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') AS tok FROM d),
n AS (SELECT doc_id, t, tok, len(list_filter(tok, lambda x: len(regexp_replace(lower(x), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) >= 3 AND (
  regexp_matches(regexp_replace(lower(x), '[^\\p{{L}}\\p{{Nd}}]', '', 'g'), '(?i)[a-z]\\d[a-z]|\\d[a-z]\\d|[a-z]{{1,2}}\\d{{2,}}[a-z]{{1,2}}')
  OR regexp_matches(x, '[\\x{{0100}}-\\x{{024F}}\\x{{0370}}-\\x{{03FF}}\\x{{0400}}-\\x{{04FF}}]')
  OR (NOT {in_list("regexp_replace(lower(x), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')".replace('{{', '{').replace('}}', '}'), lx.COMMON_OCR_WORDS)}
      AND NOT regexp_matches(regexp_replace(lower(x), '[^\\p{{L}}\\p{{Nd}}]', '', 'g'), '^\\p{{Nd}}+$')
      AND len(regexp_replace(lower(x), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) >= 6
      AND NOT regexp_matches(regexp_replace(lower(x), '[^\\p{{L}}\\p{{Nd}}]', '', 'g'), '[aeiou]'))))) AS bad FROM w)
SELECT doc_id, (len(t) >= 8 AND NOT regexp_matches(t, '[\\x{{0B80}}-\\x{{0BFF}}]') AND len(tok) >= 3
  AND bad / greatest(len(tok), 1) >= 0.40) AS garbled FROM n"""


@query("garbled_text", _GARBLE)
def garbled_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.garbled("text").alias("garbled"))


@query("screen_urls")
def screen_urls(spark, sf):
    urls = mail(spark, sf).select("email_id", tx.extract_screen_urls("body_text").alias("u"))
    return urls.select("email_id", F.explode(F.transform("u", tx.repair_screen_domain)).alias("url"))


# -- vocabulary ------------------------------------------------------------

_TOKENS = (r"list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(text), 'http\S+', '<url>', 'g'), "
           r"'[^a-z0-9\s<>\x{0B80}-\x{0BFF}]', '', 'g')), '\s+'), lambda w: w <> '')")


@query("vocabulary", f"""
SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id FROM (
  SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token
  ORDER BY n DESC, token LIMIT 7998)""")
def vocabulary(spark, sf):
    return build_vocabulary(table(spark, sf, "documents")).withColumn("token_id", F.col("token_id").cast("bigint"))


@query("token_encoding", f"""
WITH v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM (SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 7998)),
t AS (SELECT doc_id, {_TOKENS}[1:60] AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS token, unnest(range(1, len(l) + 1)) AS p FROM t),
c AS (SELECT doc_id, list(CASE WHEN coalesce(id, 1) >= 8000 THEN 1 ELSE coalesce(id, 1) END ORDER BY p) AS ids FROM u LEFT JOIN v ON u.token = v.token GROUP BY 1)
SELECT documents.doc_id, array_to_string(list_resize(coalesce(ids, []), 60, 0), ',') AS token_ids FROM documents LEFT JOIN c ON documents.doc_id = c.doc_id""")
def token_encoding(spark, sf):
    docs = table(spark, sf, "documents")
    coded = encode_tokens(docs, build_vocabulary(docs), "doc_id")
    return coded.select("doc_id", F.array_join(F.transform("token_ids", lambda x: x.cast("string")), ",").alias("token_ids"))


# -- triage ----------------------------------------------------------------

def _facts_cte() -> str:
    """What a message's domain, first link, attachment and HTML say, one row a message."""
    from riskframe.plans.header_queries import _ATT, _MIME
    from riskframe.plans.url_queries import _HOST, _brand_case

    def imitates(name, host):
        return f"""{name} AS (SELECT email_id, {_brand_case('brand')} IS NOT NULL AS imitates FROM (SELECT *, len(ps) AS nparts, CASE WHEN len(ps) >= 2 THEN ps[len(ps) - 1] ELSE '' END AS root,
  CASE WHEN len(ps) > 2 THEN array_to_string(ps[1:len(ps) - 2], '.') ELSE '' END AS sub FROM (SELECT email_id, host, string_split(host, '.') AS ps FROM ({host}))))"""

    known = (f"({under('domain', lx.TRUSTED_DOMAINS)} OR {ends_any('domain', lx.INSTITUTION_SUFFIXES)} OR {has_any('domain', lx.EDUCATION_KEYWORDS)} "
             f"OR {has_any('lower(sender)', lx.EDUCATION_KEYWORDS)})")
    first = f"SELECT email_id, {_HOST} AS host FROM (SELECT email_id, rtrim(regexp_extract_all(body_text, {quoted(tx.URL_PATTERN)})[1], '.') AS url FROM ({MAIL_SQL})) WHERE url IS NOT NULL"
    return f"""
dom AS (SELECT d.email_id, m.sender, d.domain, len(d.domain) * 13 % 120 AS age, len(d.domain) % 3 <> 0 AS mx, len(d.domain) % 4 <> 0 AS registered
  FROM ({QUERIES['domain_cleanup'].sql}) d JOIN ({MAIL_SQL}) m ON d.email_id = m.email_id),
{imitates('si', 'SELECT email_id, domain AS host FROM dom')}, {imitates('ui', first)},
att AS (SELECT doc_id AS email_id, split_part('{"|".join(_ATT)}', '|', CAST(doc_id % 6 AS INT) + 1) AS fn, split_part('{"|".join(_MIME)}', '|', CAST(doc_id % 4 AS INT) + 1) AS mt,
  doc_id % 11 = 0 AS enc, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 50 = 7) AS bad FROM documents),
fx AS (SELECT dom.email_id, CASE WHEN {known} THEN 0 WHEN si.imitates THEN 90 WHEN age < 30 THEN 85 WHEN age < 90 THEN 40 ELSE 0 END AS reg,
  CASE WHEN NOT {known} AND NOT mx AND registered AND contains(domain, '.') AND len(domain) > 4 THEN 60 ELSE 0 END AS mxs,
  coalesce(ui.imitates, false) AS uimit, NOT {known} AND si.imitates AS simit, NOT {known} AND NOT si.imitates AND age < 30 AS young,
  greatest(CASE WHEN enc THEN 75 ELSE 0 END, CASE WHEN bad THEN 100 ELSE 0 END, CASE WHEN ends_with(lower(fn), '.pdf') AND mt <> '' AND NOT contains(mt, 'pdf')
    AND NOT contains(mt, 'octet-stream') THEN 85 ELSE 0 END, CASE WHEN ends_with(fn, '.exe') OR ends_with(fn, '.js') THEN 90 ELSE 0 END) AS ats,
  bad OR ends_with(fn, '.exe') OR ends_with(fn, '.js') AS malw, CASE WHEN dom.email_id % 9 = 0 THEN 55 ELSE 0 END AS mis
  FROM dom JOIN si ON dom.email_id = si.email_id JOIN att ON dom.email_id = att.email_id LEFT JOIN ui ON dom.email_id = ui.email_id)"""


_NO_FACTS = f"fx AS (SELECT email_id, 0 AS reg, 0 AS mxs, false AS uimit, false AS simit, false AS young, 0 AS ats, false AS malw, 0 AS mis FROM ({MAIL_SQL}))"


def _triage_cte(facts: str = _NO_FACTS) -> str:
    from riskframe.plans.header_queries import _AUTH_CTE, _PEN
    from riskframe.plans.url_queries import _HOSTS_CTE, _spoof_sql

    urls = (f"SELECT email_id AS link_id, unnest(list_distinct(list_transform(regexp_extract_all(body_text, {quoted(tx.URL_PATTERN)}), "
            f"lambda x: rtrim(x, '.')))) AS url FROM ({MAIL_SQL})")
    hosts = _HOSTS_CTE.replace(LINK_SQL, urls)
    cats = ", ".join([
        "CASE WHEN simit OR uimit THEN 'PHISHING' END", "CASE WHEN simit OR uimit THEN 'IMPERSONATION' END", "CASE WHEN young THEN 'SUSPICIOUS' END",
        "CASE WHEN malw THEN 'MALWARE' END",
        "CASE WHEN nx > 0 THEN 'SENSITIVE_DATA_EXPOSURE' END", "CASE WHEN nc > 0 OR url_risk >= 50 OR short THEN 'PHISHING' END",
        f"CASE WHEN nb > 0 OR {has_any('low', lx.BEC_CATEGORY_PHRASES)} THEN 'BEC' END",
        f"CASE WHEN (nf > 0 AND nb = 0) OR {has_any('low', lx.FRAUD_CATEGORY_PHRASES)} THEN 'FRAUD' END",
        "CASE WHEN impersonating THEN 'IMPERSONATION' END", "CASE WHEN header_mismatch OR lookalike THEN 'SPOOFED' END"])
    order = " ".join(f"WHEN list_contains(cats, '{c}') THEN '{c}'" for c in lx.CATEGORY_PRIORITY)
    return f"""
{facts},
fw AS (WITH {_fwd_cte()} SELECT email_id, (q OR fwd) AS is_forwarded, concat(coalesce(osub, subject), ' ', CASE WHEN (q OR fwd) AND o <> '' THEN o ELSE b END) AS t FROM f),
sp AS ({_spoof_sql()}), ur AS (WITH {hosts} SELECT link_id AS email_id, max(risk) AS url_risk, bool_or(short) AS short FROM s GROUP BY 1),
au AS (WITH {_AUTH_CTE} SELECT email_id, spf, dkim, dmarc, CASE WHEN spf = 'UNKNOWN' AND dkim = 'UNKNOWN' AND dmarc = 'UNKNOWN' THEN 0
  ELSE {_PEN.format(c='spf')} + {_PEN.format(c='dkim')} + {_PEN.format(c='dmarc')} END AS auth_score FROM a),
n AS (SELECT fw.email_id, is_forwarded, lower(t) AS low, len({_EXPOSED}) AS nx, {hit_count('lower(t)', lx.URGENCY_PHRASES)} AS nu, {hit_count('lower(t)', lx.CREDENTIAL_PHRASES)} AS nc,
  {hit_count('lower(t)', lx.BEC_PHRASES)} AS nb, {hit_count('lower(t)', lx.FRAUD_PHRASES)} AS nf, coalesce(url_risk, 0) AS url_risk, coalesce(short, false) AS short,
  sp.score AS sps, header_mismatch, lookalike, impersonating, auth_score, NOT (spf = 'UNKNOWN' AND dkim = 'UNKNOWN' AND dmarc = 'UNKNOWN') AS known
  , reg, mxs, uimit, simit, young, ats, malw, mis
  FROM fw JOIN sp ON fw.email_id = sp.email_id JOIN au ON fw.email_id = au.email_id JOIN fx ON fw.email_id = fx.email_id LEFT JOIN ur ON fw.email_id = ur.email_id),
g AS (SELECT *, CAST(greatest(reg, mxs, CASE WHEN uimit THEN 90 ELSE 0 END, ats, mis, url_risk, CASE WHEN nu > 0 THEN least(30 + nu * 12, 90) ELSE 0 END, CASE WHEN nc > 0 THEN 85 ELSE 0 END, sps, CASE WHEN nx > 0 THEN 95 ELSE 0 END,
  CASE WHEN nb > 0 THEN 90 ELSE 0 END, CASE WHEN nf > 0 AND nb = 0 THEN 85 ELSE 0 END) AS INT) AS c, list_distinct(list_filter([{cats}], lambda x: x IS NOT NULL)) AS cats0 FROM n),
k AS (SELECT *, CASE WHEN len(cats0) = 0 AND nu > 0 THEN ['SPAM'] ELSE cats0 END AS cats FROM g),
pc AS (SELECT *, CASE {order} WHEN c >= 30 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS cat FROM k)"""


def _verdict_sql(facts: str = _NO_FACTS) -> str:
    return f"""
WITH {_triage_cte(facts)},
a1 AS (SELECT *, cat IN ('PHISHING', 'IMPERSONATION', 'SPOOFED', 'BEC', 'MALWARE') OR reg = 90 OR uimit AS mim, CAST(floor(round(c * 0.6 + auth_score * 0.4, 6)) AS INT) AS mix FROM pc),
a2 AS (SELECT *, CASE WHEN known THEN CASE WHEN mim OR c >= 40 THEN greatest(c, mix) ELSE mix END ELSE c END AS s0 FROM a1),
a3 AS (SELECT *, CASE WHEN mim OR c >= 70 OR cat IN ('SENSITIVE_DATA_EXPOSURE', 'FRAUD') THEN greatest(s0, c) ELSE s0 END AS s1 FROM a2),
a4 AS (SELECT *, CASE WHEN mim THEN greatest(s1, 85) ELSE s1 END AS s2 FROM a3),
a5 AS (SELECT *, least(100, CASE WHEN is_forwarded AND c >= 40 AND s2 < c THEN c ELSE s2 END) AS risk_score FROM a4),
a6 AS (SELECT *, CASE WHEN c < 30 AND auth_score < 30 AND NOT mim THEN 'SAFE' WHEN risk_score >= 70 OR cat IN ('SENSITIVE_DATA_EXPOSURE','PHISHING','MALWARE','BEC','IMPERSONATION') OR mim THEN 'MALICIOUS'
  WHEN risk_score >= 45 THEN 'SUSPICIOUS' WHEN risk_score >= 20 THEN 'UNVERIFIED' ELSE 'SAFE' END AS v0 FROM a5),
a7 AS (SELECT *, CASE WHEN v0 = 'SAFE' AND (c >= 40 OR mim) THEN CASE WHEN c >= 70 OR mim THEN 'MALICIOUS' ELSE 'SUSPICIOUS' END ELSE v0 END AS verdict FROM a6)
SELECT email_id, c AS content_score, auth_score, risk_score, verdict, CASE verdict WHEN 'MALICIOUS' THEN 'HIGH' WHEN 'SUSPICIOUS' THEN 'MEDIUM-HIGH' WHEN 'UNVERIFIED' THEN 'MEDIUM' ELSE 'LOW' END AS risk_band,
  cat AS primary_category, array_to_string(list_sort(list_filter(cats, lambda x: x <> cat)), ',') AS secondary_categories, is_forwarded FROM a7"""


@query("email_triage", _verdict_sql())
def email_triage(spark, sf):
    out = tr.triage(mail(spark, sf))
    return out.select(
        "email_id", "content_score", "auth_score", "risk_score", "verdict", "risk_band", "primary_category",
        F.array_join("secondary_categories", ",").alias("secondary_categories"), "is_forwarded")


@query("full_triage", f"""
SELECT t.*, coalesce(anomaly_score, 0) AS relay_score FROM ({_verdict_sql(_facts_cte())}) t LEFT JOIN ({QUERIES['relay_anomaly'].sql}) r ON t.email_id = r.email_id""")
def full_triage(spark, sf):
    """Every source at once; the relay score stands beside the verdict and never moves it."""
    from riskframe.operators.enrichment import relay_anomaly
    from riskframe.plans.header_queries import _ATT, _MIME, _located_hops

    mails = checkpointed(mail(spark, sf).withColumn("body_html", F.when(
        F.col("email_id") % 9 == 0, '<a href="http://evil.example.net/x">https://bank.example.com/</a>').otherwise("")))
    docs = table(spark, sf, "documents")
    names = mails.select(ux.clean_domain("sender").alias("domain")).distinct().filter("domain <> ''")
    domains = names.selectExpr(
        "domain", "CASE WHEN length(domain) % 4 <> 0 THEN 'Registrar' END AS registrar",
        "date_sub(DATE'2024-06-01', length(domain) * 13 % 120) AS creation_date", "length(domain) % 3 <> 0 AS has_mx")
    attachments = docs.selectExpr(
        "doc_id AS email_id", f"split_part('{'|'.join(_ATT)}', '|', CAST(doc_id % 6 AS INT) + 1) AS filename",
        f"split_part('{'|'.join(_MIME)}', '|', CAST(doc_id % 4 AS INT) + 1) AS content_type", "sha2(text, 256) AS sha256", "doc_id % 11 = 0 AS is_encrypted")
    listed = docs.filter("doc_id % 50 = 7").selectExpr("sha2(text, 256) AS sha256")
    out = tr.full_triage(mails, "email_id", domains, F.to_date(F.lit("2024-06-01")), attachments, listed)
    out = checkpointed(out.select(
        "email_id", "content_score", "auth_score", "risk_score", "verdict", "risk_band", "primary_category",
        F.array_join("secondary_categories", ",").alias("secondary_categories"), "is_forwarded"))
    relays = relay_anomaly(_located_hops(spark, sf)).select("email_id", F.col("anomaly_score").alias("relay_score"))
    return lookup_join(out, checkpointed(relays), "email_id").withColumn("relay_score", F.coalesce("relay_score", F.lit(0)))


_FIRED = ", ".join([
    "CASE WHEN url_risk > 0 THEN 'URL' END", "CASE WHEN nu > 0 THEN 'URGENCY' END", "CASE WHEN nc > 0 THEN 'CREDENTIAL' END",
    "CASE WHEN sps > 0 THEN 'SPOOFING' END", "CASE WHEN nx > 0 THEN 'EXPOSURE' END", "CASE WHEN nb > 0 THEN 'BEC' END",
    "CASE WHEN nf > 0 AND nb = 0 THEN 'FRAUD' END"])


@query("signal_risk", f"""
WITH {_triage_cte()}
SELECT email_id, c AS content_score, array_to_string(list_sort(list_filter([{_FIRED}], lambda x: x IS NOT NULL)), ',') AS signals FROM g WHERE c > 0""")
def signal_risk(spark, sf):
    return tr.content_risk(tr.signal_rows(tr.analyse_content(mail(spark, sf)), "email_id"), "email_id")


@query("triage_summaries")
def triage_summaries(spark, sf):
    return tr.triage(mail(spark, sf)).select("email_id", "verdict", "summary", F.size("risk_factors").alias("n_factors"))


_FLAG_RISK = f"""
WITH d AS (SELECT doc_id, source, text AS t FROM documents),
s AS (SELECT doc_id, source, {_SIG_SUM} AS n, len({_EXPOSED}) AS x FROM (SELECT doc_id, source, t, {_SIG_SQL} FROM d)),
v AS (SELECT source, CASE WHEN greatest(CASE WHEN x > 0 THEN 95 ELSE 0 END, least(n * 25, 100)) >= 70 THEN 'DANGER'
  WHEN greatest(CASE WHEN x > 0 THEN 95 ELSE 0 END, least(n * 25, 100)) >= 40 THEN 'WARNING' ELSE 'SAFE' END AS verdict FROM s)
SELECT source, verdict, count(*) AS n, GROUPING(source, verdict) AS grouping_level FROM v
GROUP BY GROUPING SETS ((source, verdict), (source), (verdict), ())"""


def flagship(spark, sf_dir):
    """Redacted documents, text signals, exposure, risk and verdict, rolled up by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    scored = docs.select(
        "doc_id", "source", tx.signal_count(tx.text_signals("text")).alias("n"), F.size(tx.exposed_types("text")).alias("x"))
    risk = F.greatest(F.when(F.col("x") > 0, 95).otherwise(0), F.least(F.col("n") * 25, F.lit(100)))
    verdicts = scored.select("source", fusion.three_band(risk).alias("verdict"))
    sets = [[F.col("source"), F.col("verdict")], [F.col("source")], [F.col("verdict")], []]
    return verdicts.groupingSets(sets, "source", "verdict").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("grouping_level"))


query("message_risk_rollup", _FLAG_RISK)(flagship)


@query("asset_keywords", f"""
SELECT doc_id, {hit_count('t', lx.PHISHING_PATTERNS)} AS phishing_hits, {hit_count('t', lx.SPAM_KEYWORDS)} AS spam_hits
FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def asset_keywords(spark, sf):
    from riskframe.functions.common import hit_count as count
    t = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    return t.select("doc_id", count(F.col("t"), lx.PHISHING_PATTERNS).cast("bigint").alias("phishing_hits"),
                    count(F.col("t"), lx.SPAM_KEYWORDS).cast("bigint").alias("spam_hits"))

