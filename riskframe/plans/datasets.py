"""Input tables of the queries: the given tables and tables derived from them.

Derived columns are written once as SQL expressions that Spark and the
reference database both understand, so both sides start from equal inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables whose rows are expensive to analyse.
TEXT_TABLES = {"documents", "pages", "conversations"}


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a small input.

    One small file is one scan task. Only an input with fewer partitions than
    the cluster has cores is redistributed; a large input already has many
    more and is read in place.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def pick(values: list[str], index: str) -> str:
    """SQL: the value at ``index`` modulo the list length (no ``|`` in values)."""
    return f"split_part('{'|'.join(values)}', '|', CAST(({index}) % {len(values)} AS INT) + 1)"


# -- messages --------------------------------------------------------------

_SENDERS = [
    "PayPal Security <service@paypa1-help.com>", "alice@corp-mail.com", "Google Support <support@evil.ru>",
    "amazon.billing@gmail.com", "Netflix <netflix.help@gmail.com>", "Bob <bob@microsoft.com>",
    "hr@internal.example.org", "SBI Alerts <alerts@sbi.co.in>", "noreply@nptel.ac.in",
    "Chase Bank <x@chase-login.top>", "sales@rnicrosoft.com",
]
_REPLIES = ["", "other@reply-host.com", "", "bob@microsoft.com", ""]
_RETURNS = ["", "", "bounce@mailer.example.net"]
_SUBJECTS = [
    "Urgent: verify your account", "Meeting notes", "FWD: vendor payment", "You have been selected", "Invoice",
    "Re: lunch", "Fw: lottery", "Update banking details", "Weekly report", "Your account will be suspended", "Hello",
    "Quarterly figures", "Parcel",
]
_SUFFIXES = [
    "", "Please click here to confirm your identity.", "password: hunter2secret", "Visit https://bit.ly/abc. now",
    "See http://paypa1.com/login and https://www.google.com/a.", "share your otp with us immediately",
    "OTP is 483920", "This is an urgent wire for a vendor payment.", "",
    "~---------- Forwarded message ----------~From: Eve <eve@bad.com>~Date: Mon, 1 Jan~Subject: inheritance~~million dollars for you",
    "~From: Mallory~Date: Tue, 2 Jan~Subject: prize~claim your prize", "http://10.0.0.5/setup http://shop.xyz/x",
    "Do not share your otp. call 1800", "upi://pay?pa=x@upi collect", "cashback credited in wallet, valid for 2 mins",
    "api_key = abcdefghij0123456789", "Begin forwarded message: text only",
]
_AUTHS = [
    "",
    "mx.google.com; spf=pass (sender IP is 8.8.4.4) smtp.mailfrom=a.com; dkim=pass header.d=a.com; dmarc=pass (p=REJECT) header.from=a.com",
    "mx.x.net; spf=fail (not allowed) smtp.mailfrom=b.com; dkim=none; dmarc=fail action=none",
    "spf=softfail (weak); dkim=temperror", "spf=pass; dkim=pass header.i=@x; dmarc=bestguesspass",
    "SPF = NEUTRAL; something else",
]
_HOSTS = ["mail.corp.example.net", "smtp-out.evil.ru", "localhost", "relay.isp.example.org"]
_BYS = ["by mx.google.com", "by mail.isp.net", "", "by outlook.com"]

_OCTETS = {
    "ip_a": "concat(CAST(doc_id * 7 % 223 + 1 AS INT), '.', CAST(doc_id % 256 AS INT), '.', CAST(doc_id * 13 % 256 AS INT), '.', CAST(doc_id * 3 % 256 AS INT))",
    "ip_b": pick(["10.0.0.5", "192.168.1.9", "172.16.4.2", "127.0.0.1", "169.254.3.3", "100.64.1.1", "203.0.113.7", "8.8.8.8", "142.250.190.46"], "doc_id"),
}
MAIL_COLUMNS = {
    "email_id": "doc_id",
    "sender": pick(_SENDERS, "doc_id"),
    "reply_to": pick(_REPLIES, "doc_id"),
    "return_path": pick(_RETURNS, "doc_id"),
    "subject": pick(_SUBJECTS, "doc_id"),
    "body_text": f"concat(text, ' ', replace({pick(_SUFFIXES, 'doc_id')}, '~', chr(10)))",
    "authentication_results": pick(_AUTHS, "doc_id"),
    "top_hop": f"concat('from ', {pick(_HOSTS, 'doc_id')}, ' (unknown [', {_OCTETS['ip_b']}, ']) ', {pick(_BYS, 'doc_id')}, ' with ESMTP; Mon, 01 Jan 2024 10:00:00 -0800')",
    "low_hop": f"concat('from origin.example.com ([', {_OCTETS['ip_a']}, ']) by mail', CAST(doc_id % 5 AS INT), '.isp.net with SMTP; Mon, 01 Jan 2024 09:59:12 -0800')",
    "n_hops": "CAST(doc_id % 3 AS INT)",
    "x_originating_ip": pick(["", "[8.8.4.4]", "[10.1.1.1]", ""], "doc_id"),
    "source": "source",
}
MAIL_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in MAIL_COLUMNS.items()) + " FROM documents"


def mail(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """E-mails built from the documents table; ``more`` are further columns as expressions over it."""
    df = table(spark, sf_dir, "documents").selectExpr(*[f"{e} AS {n}" for n, e in MAIL_COLUMNS.items()], *more)
    hops = F.slice(F.array("top_hop", "low_hop"), 1, F.col("n_hops"))
    headers = F.map_from_arrays(
        F.array(F.lit("x-originating-ip"), F.lit("authentication-results")),
        F.array("x_originating_ip", "authentication_results"))
    return df.withColumns({"received_headers": hops, "raw_headers": headers})


# -- links -----------------------------------------------------------------

_LINK_HEADS = [
    "https://bit.ly/", "http://paypa1.com/login/", "http://192.168.1.5/admin/", "https://www.google.com/search/",
    "http://microsoft-support.com/", "https://shop.example.xyz/item/", "http://paypal.com.attacker.net/",
    "https://login.onlinesbi.sbi/", "http://g00gle-verify.top/signin?id=", "https://gooogle.com/",
    "ftp://files.example.org/", "https://sub.netflix.com/watch/", "javascript:alert/", "https://iitm.ac.in/course/",
    "http://8.8.8.8/", "https://icicl.com/", "https://example.co.uk/a%20b//redirect/", "https://amaz0n.in.secure.tk/",
]
LINK_SQL = (
    "SELECT page_id AS link_id, url FROM pages UNION ALL "
    f"SELECT page_id + 1000000000 AS link_id, concat({pick(_LINK_HEADS, 'page_id')}, CAST(page_id AS VARCHAR(20))) AS url FROM pages"
)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page URLs and, per page, one URL of a risky or imitating shape."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    made = pages.selectExpr("page_id + 1000000000 AS link_id",
                            f"concat({pick(_LINK_HEADS, 'page_id')}, CAST(page_id AS STRING)) AS url")
    return pages.select(F.col("page_id").alias("link_id"), "url").union(made)


# -- scans -----------------------------------------------------------------

_VERDICT = "CASE event_type WHEN 'error' THEN 'DANGER' WHEN 'signup' THEN 'WARNING' ELSE 'SAFE' END"
SCAN_COLUMNS = {
    "id": "event_id", "ts": "CAST(ts AS TIMESTAMP)", "sender": "concat('user', CAST(user_id AS {text}))",
    "user_id": "user_id", "verdict": _VERDICT, "value": "value", "event_type": "event_type",
    "content": "props", "risk_score": "CAST(floor(value) AS INT) % 101",
    "subject": "concat('Subject ', event_type)", "snippet": "props",
}


def _typed(expr: str, text: str) -> str:
    return expr.replace("{text}", text)


SCAN_SQL = "SELECT " + ", ".join(f"{_typed(e, 'VARCHAR')} AS {n}" for n, e in SCAN_COLUMNS.items()) + " FROM events"


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan history built from the events table."""
    return table(spark, sf_dir, "events").selectExpr(
        *[f"{_typed(e, 'STRING')} AS {n}" for n, e in SCAN_COLUMNS.items()])


# -- predictions -----------------------------------------------------------

PREDICTION_COLUMNS = {
    "sample_id": "doc_id",
    "expected": "CASE WHEN toxic = 1 AND quality = 0 THEN 'MALICIOUS' WHEN toxic = 1 THEN 'PHISHING' WHEN quality = 0 THEN 'SUSPICIOUS' ELSE 'SAFE' END",
    "verdict": "CASE WHEN (doc_id * 37 + toxic * 41) % 100 >= 70 THEN 'DANGER' WHEN (doc_id * 37 + toxic * 41) % 100 >= 40 THEN 'WARNING' ELSE 'SAFE' END",
    "ml_score": "CAST((doc_id * 37 + toxic * 41) % 100 AS INT)",
    "url": "CAST(doc_id * 11 % 101 AS DOUBLE) / 100", "nlp": "CAST(doc_id * 17 % 101 AS DOUBLE) / 100",
    "structural": "CAST(doc_id * 23 % 101 AS DOUBLE) / 100", "typosquat": "CAST(doc_id % 2 AS DOUBLE)",
    "category": "CASE WHEN toxic = 1 THEN 'SCAM' WHEN quality = 0 THEN 'BORDERLINE' ELSE 'LEGIT' END",
    "label": "toxic",
}
PREDICTION_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in PREDICTION_COLUMNS.items()) + " FROM labels"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr(*[f"{e} AS {n}" for n, e in PREDICTION_COLUMNS.items()])


# -- indicators ------------------------------------------------------------

IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of documents (digest, IPv4 strings, addresses) and pages (host)."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    case = F.concat(F.lit("D"), F.col("doc_id").cast("string"))
    one = lambda k, v: F.struct(F.lit(k).alias("t"), v.alias("v"))
    found = lambda k, p: F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), lambda v: one(k, v))
    rows = F.concat(
        F.array(one("attachment_hash", F.sha2("text", 256))), found("origin_ip", IPV4),
        found("sender_email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"))
    from_docs = docs.select(case.alias("case_id"), F.explode(rows).alias("r")).select("case_id", "r.t", "r.v")
    from_pages = pages.select(
        F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("case_id"), F.lit("url_domain").alias("t"),
        F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)).alias("v"))
    return from_docs.union(from_pages).select(
        "case_id", F.col("t").alias("indicator_type"), F.col("v").alias("indicator_value"),
        F.lower("v").alias("normalized_value")).distinct()


INDICATOR_SQL = f"""
SELECT DISTINCT case_id, t AS indicator_type, v AS indicator_value, lower(v) AS normalized_value FROM (
  SELECT concat('D', doc_id) AS case_id, 'attachment_hash' AS t, sha256(text) AS v FROM documents
  UNION ALL SELECT concat('D', doc_id), 'origin_ip', unnest(regexp_extract_all(text, '{IPV4}')) FROM documents
  UNION ALL SELECT concat('D', doc_id), 'sender_email',
    unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}')) FROM documents
  UNION ALL SELECT concat('P', page_id), 'url_domain', lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) FROM pages)
"""


def case_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case row per document and page."""
    docs = table(spark, sf_dir, "documents").selectExpr(
        "concat('D', CAST(doc_id AS STRING)) AS case_id", "doc_id AS n", "concat('s', source, '@mail', CAST(doc_id % 5 AS STRING), '.com') AS sender")
    pages = table(spark, sf_dir, "pages").selectExpr(
        "concat('P', CAST(page_id AS STRING)) AS case_id", "page_id AS n", "'' AS sender")
    return docs.union(pages).withColumns({
        "verdict": F.expr("CASE n % 4 WHEN 0 THEN 'MALICIOUS' WHEN 1 THEN 'SUSPICIOUS' WHEN 2 THEN 'UNVERIFIED' ELSE 'SAFE' END"),
        "risk_score": F.expr("CAST(n * 7 % 101 AS INT)"),
        "primary_category": F.expr("CASE n % 3 WHEN 0 THEN 'PHISHING' WHEN 1 THEN 'BEC' ELSE 'SAFE' END"),
        "subject": F.expr("concat('Case ', CAST(n AS STRING), ' review_', CAST(n % 9 AS STRING))"),
        "ts": F.expr("timestamp_seconds(1704067200 + n * 3600)"),
    }).drop("n")


CASE_SQL = """
SELECT case_id, sender,
  CASE n % 4 WHEN 0 THEN 'MALICIOUS' WHEN 1 THEN 'SUSPICIOUS' WHEN 2 THEN 'UNVERIFIED' ELSE 'SAFE' END AS verdict,
  CAST(n * 7 % 101 AS INT) AS risk_score,
  CASE n % 3 WHEN 0 THEN 'PHISHING' WHEN 1 THEN 'BEC' ELSE 'SAFE' END AS primary_category,
  concat('Case ', n, ' review_', n % 9) AS subject,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(n AS INT)) AS ts
FROM (SELECT concat('D', doc_id) AS case_id, doc_id AS n, concat('s', source, '@mail', doc_id % 5, '.com') AS sender FROM documents
      UNION ALL SELECT concat('P', page_id), page_id, '' FROM pages)
"""
