"""Mail sources: raw messages, mail-API JSON and notification triggers.

Whole files are read by Spark; only the MIME parsing of one message runs in
Python, in Arrow batches over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.common import strip, text
from riskframe.functions.text import extract_urls
from riskframe.schemas import GRAPH_MESSAGE, PARSED_MAIL, PARSED_MAIL_COLUMNS, TRIGGER


def _parse_messages(batches):
    """MIME bytes to header, body and attachment columns; a bad message yields an error row."""
    import hashlib
    from email import policy
    from email.parser import BytesParser

    import pandas as pd

    def body_of(part):
        return (part.get_payload(decode=True) or b"").decode("utf-8", errors="replace")

    def one(raw: bytes) -> dict:
        msg = BytesParser(policy=policy.default).parsebytes(raw or b"")
        row = {"body_text": "", "body_html": "", "attachments": [], "parse_error": None}
        row["raw_headers"] = {k.lower(): str(msg[k]) for k in msg.keys()}
        row["received_headers"] = [str(h) for h in msg.get_all("Received", [])]
        parts = list(msg.walk()) if msg.is_multipart() else [msg]
        for part in parts:
            kind, name = part.get_content_type(), part.get_filename()
            if msg.is_multipart() and ("attachment" in str(part.get("Content-Disposition", "")) or name):
                data = part.get_payload(decode=True) or b""
                row["attachments"].append({
                    "filename": name or "unnamed_attachment", "content_type": kind, "size_bytes": len(data),
                    "sha256": hashlib.sha256(data).hexdigest(), "is_encrypted": False})
            elif kind == "text/html":
                row["body_html"] = body_of(part) or row["body_html"]
            elif kind == "text/plain" or not msg.is_multipart():
                row["body_text"] = body_of(part) or row["body_text"]
        return row

    empty = {"raw_headers": {}, "received_headers": [], "body_text": "", "body_html": "", "attachments": []}
    for pdf in batches:
        rows = []
        for key, provider, raw in zip(pdf["source"], pdf["provider_type"], pdf["content"]):
            try:
                row = one(raw)
            except Exception as error:  # a malformed message must not fail the job
                row = {**empty, "parse_error": f"{type(error).__name__}: {error}"[:200]}
            rows.append({"source": key, "provider_type": provider, **row})
        yield pd.DataFrame(rows, columns=PARSED_MAIL_COLUMNS)


def _normalise(parsed: DataFrame) -> DataFrame:
    head = lambda name: F.coalesce(F.col("raw_headers")[name], F.lit(""))
    body = F.when(F.col("body_text") != "", F.col("body_text")).otherwise(F.col("body_html"))
    return parsed.select(
        F.sha2(F.concat_ws("|", "source", head("message-id")), 256).alias("email_id"), "provider_type",
        head("message-id").alias("provider_message_id"), head("from").alias("sender"),
        F.filter(F.transform(F.split(head("to"), ","), strip), lambda r: r != "").alias("recipients"),
        F.when(head("reply-to") != "", head("reply-to")).alias("reply_to"), head("return-path").alias("return_path"),
        head("subject").alias("subject"), head("date").alias("date_raw"), "body_text", "body_html", "raw_headers",
        "received_headers", head("authentication-results").alias("authentication_results"),
        extract_urls(body).alias("urls"), "attachments", F.create_map(F.lit("source"), F.col("source")).alias("provider_metadata"),
        "parse_error")


def parse_mail(df: DataFrame) -> DataFrame:
    """``source, provider_type, content`` (bytes) to the message table."""
    return _normalise(df.select("source", "provider_type", "content").mapInPandas(_parse_messages, PARSED_MAIL))


def read_eml(spark: SparkSession, path: str, provider: str = "RFC822_EML") -> DataFrame:
    """All message files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return parse_mail(files.select(F.col("path").alias("source"), F.lit(provider).alias("provider_type"), "content"))


def read_raw_text(df: DataFrame, raw: str, key: str, provider: Column | str) -> DataFrame:
    """Pasted or fetched message sources held in a text column."""
    tag = F.lit(provider) if isinstance(provider, str) else provider
    return parse_mail(df.select(
        F.col(key).cast("string").alias("source"), tag.alias("provider_type"), F.encode(text(raw), "UTF-8").alias("content")))


def read_graph_json(spark: SparkSession, path: str) -> DataFrame:
    """Mail-API message JSON, by schema and expressions only."""
    return graph_messages(spark.read.schema(GRAPH_MESSAGE).option("multiLine", "true").json(path))


def graph_messages(raw: DataFrame) -> DataFrame:
    headers = F.filter(
        F.coalesce("internetMessageHeaders", F.array().cast("array<struct<name:string,value:string>>")), lambda h: h["name"].isNotNull())
    lowered = F.transform(headers, lambda h: F.struct(F.lower(h["name"]).alias("k"), F.coalesce(h["value"], F.lit("")).alias("v")))
    content, html = text("body.content"), F.lower(text("body.contentType")) == "html"
    df = raw.withColumns({"_h": lowered, "_m": F.map_from_entries(lowered)})
    return df.select(
        F.sha2(text("id"), 256).alias("email_id"), F.lit("MICROSOFT_GRAPH").alias("provider_type"),
        text("id").alias("provider_message_id"),
        F.trim(F.concat(text("from.emailAddress.name"), F.lit(" <"), text("from.emailAddress.address"), F.lit(">"))).alias("sender"),
        F.transform("toRecipients", lambda r: F.coalesce(r["emailAddress"]["address"], F.lit(""))).alias("recipients"),
        F.col("_m")["reply-to"].alias("reply_to"), F.coalesce(F.col("_m")["return-path"], F.lit("")).alias("return_path"),
        text("subject").alias("subject"), F.col("receivedDateTime").alias("date_raw"),
        F.when(html, "").otherwise(content).alias("body_text"), F.when(html, content).otherwise("").alias("body_html"),
        F.col("_m").alias("raw_headers"),
        F.transform(F.filter("_h", lambda h: h["k"] == "received"), lambda h: h["v"]).alias("received_headers"),
        F.coalesce(F.col("_m")["authentication-results"], F.lit("")).alias("authentication_results"),
        extract_urls(content).alias("urls"), F.create_map(F.lit("conversation_id"), text("conversationId")).alias("provider_metadata"))


def read_triggers(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Notification triggers; rows with neither sender nor subject are dropped."""
    reader = spark.readStream if stream else spark.read
    return trigger_rows(reader.schema(TRIGGER).json(path))


def trigger_rows(df: DataFrame) -> DataFrame:
    body = F.when(text("body") != "", text("body")).otherwise(text("snippet"))
    kept = df.filter((strip(text("sender")) != "") | (strip(text("subject")) != ""))
    return kept.withColumns({"body_text": body, "full_payload": has_full_payload(kept)})


def has_full_payload(df: DataFrame) -> Column:
    """A complete message rather than a notification snippet."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0 if c in df.columns else F.lit(False)
    return (text("body") != "") | (text("authentication_results") != "") | size("received_headers") | size("urls")
