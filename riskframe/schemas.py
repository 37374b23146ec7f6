"""Explicit schemas of the landed inputs and stored tables, as DDL."""

from __future__ import annotations

ATTACHMENT = "struct<filename:string,content_type:string,size_bytes:bigint,sha256:string,is_encrypted:boolean>"
PARSED_MAIL = (
    "source string, provider_type string, raw_headers map<string,string>, received_headers array<string>, "
    f"body_text string, body_html string, attachments array<{ATTACHMENT}>, parse_error string")
GRAPH_MESSAGE = (
    "id string, subject string, `from` struct<emailAddress:struct<name:string,address:string>>, "
    "toRecipients array<struct<emailAddress:struct<address:string>>>, body struct<contentType:string,content:string>, "
    "internetMessageHeaders array<struct<name:string,value:string>>, receivedDateTime string, conversationId string")
TRIGGER = (
    "sender string, subject string, snippet string, body string, urls array<string>, authentication_results string, "
    "received_headers array<string>, event_ts timestamp")
CASES = (
    "case_id string, ts timestamp, sender string, subject string, verdict string, risk_score int, "
    "primary_category string, evidence_hash string")
INDICATORS = (
    "case_id string, indicator_type string, indicator_value string, normalized_value string, ts timestamp")
SCANS = (
    "id bigint, ts timestamp, app_source string, sender string, subject string, verdict string, risk_score int, "
    "category string, sender_trust string, summary string, flags array<string>, action string, ml_score int, ai_score int, "
    "snippet string, flagged_urls string, reviewed boolean, feedback string, typosquat boolean, reputation double, "
    "uncertainty_reason string, disagreement double")
FINDINGS_JSON = "array<struct<cat:string,desc:string,sev:int>>"
RAW_FEATURES = ("sha256 string, appeared string, label int, avclass string")
LABELLED_TEXT = ("text string, label int")
PARSED_MAIL_COLUMNS = [
    "source", "provider_type", "raw_headers", "received_headers", "body_text", "body_html", "attachments", "parse_error",
]
