"""Queries that pass derived raw inputs through the source parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import text as tx
from riskframe.plans.datasets import MAIL_SQL, SCAN_SQL, mail, scans, table
from riskframe.plans.registry import query
from riskframe.schemas import GRAPH_MESSAGE, TRIGGER
from riskframe.sources import mail as ml
from riskframe.sources.writers import pack_region_scans


def _raw(spark, sf):
    """RFC 822 text built from the derived mails (header-safe bodies)."""
    raw = F.concat_ws(
        "\r\n", F.concat(F.lit("From: "), "sender"), F.lit("To: a@b.com, c@d.com"), F.concat(F.lit("Subject: "), "subject"),
        F.concat(F.lit("Message-ID: <"), F.col("email_id").cast("string"), F.lit("@x>")), F.concat(F.lit("Received: "), "top_hop"),
        F.concat(F.lit("Received: "), "low_hop"), F.lit("Content-Type: text/plain; charset=utf-8"), F.lit(""), F.lit("see http://a.com/x. end"))
    return mail(spark, sf).select("email_id", "sender", raw.alias("raw"))


@query("raw_mail_parse", f"""
SELECT email_id, sender, subject, 2 AS n_received, 2 AS n_recipients, 'http://a.com/x' AS urls, 'GENERIC_IMAP' AS provider_type FROM ({MAIL_SQL})""")
def raw_mail_parse(spark, sf):
    parsed = ml.read_raw_text(_raw(spark, sf), "raw", "email_id", "GENERIC_IMAP")
    return parsed.select(
        F.regexp_extract("provider_message_id", r"<(\d+)@", 1).cast("bigint").alias("email_id"), "sender", "subject",
        F.size("received_headers").alias("n_received"), F.size("recipients").alias("n_recipients"), F.array_join("urls", " ").alias("urls"), "provider_type")


@query("graph_mail_parse", f"""
SELECT email_id, concat('User ', email_id, ' <u', email_id, '@x.com>') AS sender, subject, email_id % 2 = 0 AS is_html, top_hop AS received, authentication_results FROM ({MAIL_SQL})""")
def graph_mail_parse(spark, sf):
    n = F.col("email_id").cast("string")
    doc = F.to_json(F.struct(
        n.alias("id"), "subject",
        F.struct(F.struct(F.concat(F.lit("User "), n).alias("name"), F.concat(F.lit("u"), n, F.lit("@x.com")).alias("address")).alias("emailAddress")).alias("from"),
        F.array(F.struct(F.struct(F.lit("t@x.com").alias("address")).alias("emailAddress"))).alias("toRecipients"),
        F.struct(F.when(F.col("email_id") % 2 == 0, "html").otherwise("text").alias("contentType"), F.col("body_text").alias("content")).alias("body"),
        F.array(F.struct(F.lit("Received").alias("name"), F.col("top_hop").alias("value")),
                F.struct(F.lit("Authentication-Results").alias("name"), F.col("authentication_results").alias("value"))).alias("internetMessageHeaders")))
    raw = mail(spark, sf).select("email_id", F.from_json(doc, GRAPH_MESSAGE).alias("m")).select("email_id", "m.*")
    out = ml.graph_messages(raw)
    return out.select(F.col("provider_message_id").cast("bigint").alias("email_id"), "sender", "subject",
                      (F.col("body_html") != "").alias("is_html"), F.array_join("received_headers", "|").alias("received"), "authentication_results")


@query("trigger_rows", f"""
SELECT id, subject, id % 2 = 0 AS full_payload, CASE WHEN id % 2 = 0 THEN 'body' ELSE content END AS body_text FROM ({SCAN_SQL}) WHERE id % 5 <> 0 OR id % 3 = 0""")
def trigger_rows(spark, sf):
    doc = F.to_json(F.struct(
        F.when(F.col("id") % 5 != 0, F.col("sender")).otherwise(" ").alias("sender"),
        F.when((F.col("id") % 5 != 0) | (F.col("id") % 3 == 0), F.col("subject")).otherwise("").alias("subject"),
        F.col("content").alias("snippet"), F.when(F.col("id") % 2 == 0, "body").otherwise("").alias("body")))
    raw = scans(spark, sf).select("id", F.from_json(doc, TRIGGER).alias("t")).select("id", "t.*")
    return ml.trigger_rows(raw).select("id", "subject", "full_payload", "body_text")


@query("merged_urls", f"""
SELECT email_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(body_text, '(?i)https?://[^\\s<>"'')\\]}},;]+'),
  ['upi://pay?pa=x', 'ftp://no', 'HTTP://Q.com']), lambda u: regexp_matches(lower(u), '^(https?|upi)://')))), ' ') AS urls FROM ({MAIL_SQL})""".replace("}},;", "},;"))
def merged_urls(spark, sf):
    found = F.regexp_extract_all("body_text", F.lit(tx.URL_PATTERN), F.lit(0))
    other = F.array(*[F.lit(u) for u in ("upi://pay?pa=x", "ftp://no", "HTTP://Q.com")])
    return mail(spark, sf).select("email_id", F.array_join(F.array_sort(tx.merge_urls(found, other)), " ").alias("urls"))


@query("region_packing", f"""
SELECT p.page_id, concat(p.url, ',', l.u) AS extracted_urls, concat('Do not tap links', '|', 'Block sender') AS recommended_actions
FROM pages p JOIN (SELECT page_id, concat('http://x', page_id) AS u FROM pages) l ON p.page_id = l.page_id""")
def region_packing(spark, sf):
    df = table(spark, sf, "pages").select(
        "page_id", F.array("url", F.concat(F.lit("http://x"), F.col("page_id").cast("string"))).alias("urls"),
        F.array(F.lit("Do not tap links"), F.lit("Block sender")).alias("actions"))
    return pack_region_scans(df)


