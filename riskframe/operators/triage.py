"""Message triage end to end: content analysis, fusion, verdict rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.functions import fusion
from riskframe.functions.common import clamp, compact, contains_any, hits
from riskframe.functions.headers import parse_auth
from riskframe.functions.text import (
    exposed_types, extract_urls, forwarded_by_header, forwarding, link_mismatches,
)
from riskframe.functions.urls import brand_imitation, host_assessment, host_of, spoof_check, url_assessment, url_scheme
from riskframe.operators.joins import lookup_join
from riskframe.session import checkpointed


def url_rollup(url_scores: DataFrame, key: str) -> DataFrame:
    return url_scores.groupBy(key).agg(
        F.max("risk_score").alias("url_risk"), F.bool_or("is_shortener").alias("any_shortener"),
        F.bool_or("suspicious_tld").alias("any_bad_tld"), F.bool_or("ip_based").alias("any_ip"),
        F.bool_or("is_brand_impersonation").alias("any_imitation"), F.count(F.lit(1)).alias("n_urls"))


def url_summary(urls: Column) -> Column:
    """The same roll-up over the URL array of one message, without a shuffle."""
    rated = F.transform(urls, url_assessment)
    have = lambda f: F.exists(rated, lambda a: a[f])
    return F.struct(
        F.coalesce(F.array_max(F.transform(rated, lambda a: a["risk_score"])), F.lit(0)).alias("url_risk"),
        have("is_shortener").alias("any_shortener"), have("suspicious_tld").alias("any_bad_tld"),
        have("ip_based").alias("any_ip"), have("is_brand_impersonation").alias("any_imitation"))


def rated_links(messages: DataFrame, key: str, urls: str = "urls") -> DataFrame:
    """Link signals of each message: ``url_signals``, the first link's host ``url_domain`` and ``url_imitation``.

    A host under a scheme is rated once, however many links name it, and joined back; adaptive execution measures the rated
    hosts before it broadcasts them and splits hot hosts. Messages without links are not in the result.
    """
    links = messages.select(key, F.posexplode(urls).alias("_at", "_url"))
    links = links.select(key, "_at", host_of(F.col("_url")).alias("_host"), url_scheme(F.col("_url")).alias("_scheme"))
    hosts = links.select("_host", "_scheme").distinct()
    rated = hosts.withColumn("_a", host_assessment(F.col("_host"), F.col("_scheme")))
    met = lookup_join(links, rated, ["_host", "_scheme"])
    first = F.min_by(F.struct("_host", F.col("_a.is_brand_impersonation").alias("imitates")), "_at")
    rolled = met.groupBy(key).agg(
        F.max("_a.risk_score").alias("url_risk"), F.bool_or("_a.is_shortener").alias("any_shortener"), F.bool_or("_a.suspicious_tld").alias("any_bad_tld"),
        F.bool_or("_a.ip_based").alias("any_ip"), F.bool_or("_a.is_brand_impersonation").alias("any_imitation"), first.alias("_first"))
    return rolled.select(key, F.struct("url_risk", "any_shortener", "any_bad_tld", "any_ip", "any_imitation").alias("url_signals"),
                         F.col("_first._host").alias("url_domain"), F.col("_first.imitates").alias("url_imitation"))


def attachment_facts(attachments: DataFrame, bad_hashes: DataFrame, key: str) -> DataFrame:
    """Worst attachment of each message. A digest is looked up once, however many messages carry it."""
    from riskframe.operators.enrichment import attachment_risk, known_bad_attachments

    listed = known_bad_attachments(attachments.select("sha256").distinct(), bad_hashes).select("sha256").withColumn("known_bad", F.lit(True))
    rated = attachment_risk(lookup_join(attachments.withColumn("sha256", F.lower("sha256")), listed.distinct(), "sha256"))
    each = F.array_sort(F.collect_list(F.struct("filename", "attachment_factors")))
    return rated.groupBy(key).agg(
        F.max("attachment_score").alias("attachment_score"), F.bool_or("is_malware").alias("has_malware"),
        F.flatten(F.transform(each, lambda a: a["attachment_factors"])).alias("attachment_factors"))


def full_triage(messages: DataFrame, key: str = "email_id", domains: DataFrame | None = None, as_of: Column | None = None,
                attachments: DataFrame | None = None, bad_hashes: DataFrame | None = None, allow_verified: bool = False) -> DataFrame:
    """One verdict from all sources: text, links, sender and link domains, attachments, HTML and authentication.

    ``domains`` (``enrich_domains``) with the day ages are counted to, ``attachments`` (key, filename, content_type, sha256,
    is_encrypted) with ``bad_hashes`` (sha256) are optional. Sender domains, link hosts and digests are rated once each;
    what they say of a message is a narrow table, written before it is joined.
    Facts of the relay path are reported elsewhere and never scored.
    """
    from riskframe.operators.enrichment import enrich_domains

    own = messages if "urls" in messages.columns else messages.withColumn("urls", extract_urls("body_text"))
    links = checkpointed(rated_links(own, key))
    out = lookup_join(own, links.drop("url_imitation"), key).withColumn("url_signals", F.coalesce("url_signals", no_links()))
    if domains is not None:
        facts = enrich_domains(lookup_join(own.select(key, "sender"), links.drop("url_signals"), key), domains, as_of)
        senders = checkpointed(facts.select("domain").distinct().withColumn("sender_imitation", brand_imitation("domain").isNotNull()))
        facts = fusion.domain_signals(lookup_join(facts, senders, "domain"))
        facts = facts.select(key, "registration_score", "mx_score", "url_imitation_score", "domain_categories")
        out = lookup_join(out, checkpointed(facts), key)
    if attachments is not None:
        out = lookup_join(out, checkpointed(attachment_facts(attachments, bad_hashes, key)), key)
    return triage(out, allow_verified)


def no_links() -> Column:
    false = F.lit(False)
    return F.struct(F.lit(0).alias("url_risk"), false.alias("any_shortener"), false.alias("any_bad_tld"), false.alias("any_ip"), false.alias("any_imitation"))


def analyse_content(df: DataFrame) -> DataFrame:
    """Content rules over a table of messages, one row in, one row out.

    Needs ``sender, subject, body_text``; uses ``body_html, reply_to,
    return_path, urls, raw_headers`` and, where the caller has joined them
    (``full_triage``), ``url_signals``, ``registration_score, mx_score,
    url_imitation_score, domain_categories`` (``fusion.domain_signals``) and
    ``attachment_score, has_malware, attachment_factors``.
    No shuffle: everything is a projection.
    """
    have = set(df.columns)
    string = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0)
    body = F.when(string("body_text") != "", string("body_text")).otherwise(string("body_html"))
    df = df.withColumns({"_body": body, "_subject": string("subject")})
    df = df.withColumn("forwarding", forwarding("_body", "_subject"))
    own = F.col("forwarding.is_forwarded") & (F.col("forwarding.original_content") != "")
    content = F.when(own, F.col("forwarding.original_content")).otherwise(F.col("_body"))
    subject = F.coalesce(F.col("forwarding.original_subject"), F.col("_subject"))
    df = df.withColumn("_full", F.concat_ws(" ", subject, content))
    df = df.withColumns({
        "_lower": F.lower("_full"),
        "_urls": F.col("urls") if "urls" in have else extract_urls("_body"),
        "exposure_types": exposed_types("_full"),
        "spoof": spoof_check(string("sender"), string("reply_to"), string("return_path")),
        "link_mismatches": link_mismatches(string("body_html")) if "body_html" in have else F.lit(0),
    })
    lower = F.col("_lower")
    df = df.withColumns({
        "url_signals": F.col("url_signals") if "url_signals" in have else url_summary(F.col("_urls")),
        "urgency_hits": hits(lower, lx.URGENCY_PHRASES), "credential_hits": hits(lower, lx.CREDENTIAL_PHRASES),
        "bec_hits": hits(lower, lx.BEC_PHRASES), "fraud_hits": hits(lower, lx.FRAUD_PHRASES),
    })
    n = lambda c: F.size(c)
    attachments = number("attachment_score")
    malware = F.coalesce(F.col("has_malware"), F.lit(False)) if "has_malware" in have else F.lit(False)
    risk = F.greatest(
        number("registration_score"), number("mx_score"), number("url_imitation_score"), F.col("url_signals.url_risk"),
        F.when(n("urgency_hits") > 0, F.least(F.lit(30) + n("urgency_hits") * 12, F.lit(90))).otherwise(0),
        F.when(n("credential_hits") > 0, 85).otherwise(0), F.col("spoof.score"), attachments,
        F.when(F.col("link_mismatches") > 0, F.least(F.lit(40) + F.col("link_mismatches") * 15, F.lit(80))).otherwise(0),
        F.when(n("exposure_types") > 0, 95).otherwise(0), F.when(n("bec_hits") > 0, 90).otherwise(0),
        F.when((n("fraud_hits") > 0) & (n("bec_hits") == 0), 85).otherwise(0))
    fired = F.filter(F.array(
        F.when(n("exposure_types") > 0, "SENSITIVE_DATA_EXPOSURE"), F.when(malware, "MALWARE"),
        F.when((n("credential_hits") > 0) | (F.col("url_signals.url_risk") >= 50) | F.col("url_signals.any_shortener"), "PHISHING"),
        F.when((n("bec_hits") > 0) | contains_any(lower, lx.BEC_CATEGORY_PHRASES), "BEC"),
        F.when(((n("fraud_hits") > 0) & (n("bec_hits") == 0)) | contains_any(lower, lx.FRAUD_CATEGORY_PHRASES), "FRAUD"),
        F.when(F.col("spoof.impersonating"), "IMPERSONATION"),
        F.when(F.col("spoof.header_mismatch") | F.col("spoof.lookalike"), "SPOOFED")), lambda c: c.isNotNull())
    if "domain_categories" in have:
        fired = F.array_distinct(F.concat(F.coalesce("domain_categories", F.array().cast("array<string>")), fired))
    df = df.withColumn("categories", fired)
    df = df.withColumn("categories", F.when(
        (n("categories") == 0) & (n("urgency_hits") > 0), F.array(F.lit("SPAM"))).otherwise(F.col("categories")))
    first3 = lambda c: F.array_join(F.slice(F.col(c), 1, 3), ", ")
    say = lambda text, c: F.concat(F.lit(text), c)
    factors = F.concat(
        compact(
            F.when(F.col("url_signals.any_shortener"), F.lit("Contains link shortener(s) hiding final destination")),
            F.when(F.col("url_signals.any_bad_tld"), F.lit("Links use suspicious top-level domain(s)")),
            F.when(F.col("url_signals.any_ip"), F.lit("Link(s) use raw IP address instead of domain name")),
            F.when(n("urgency_hits") > 0, say("Urgency/social-engineering language: ", first3("urgency_hits"))),
            F.when(n("credential_hits") > 0, say("Credential harvesting language: ", first3("credential_hits")))),
        F.col("spoof.factors"),
        F.coalesce("attachment_factors", F.array().cast("array<string>")) if "attachment_factors" in have else F.array().cast("array<string>"),
        compact(
            F.when(F.col("link_mismatches") > 0, F.format_string(
                "%d link(s) with mismatched display text vs. actual URL", F.col("link_mismatches"))),
            F.when(n("exposure_types") > 0, F.concat(
                F.lit("SENSITIVE DATA EXPOSED: "), F.array_join("exposure_types", ", "), F.lit(" — credentials MASKED in report"))),
            F.when(n("bec_hits") > 0, say("Business Email Compromise (BEC) signal detected: ", first3("bec_hits"))),
            F.when((n("fraud_hits") > 0) & (n("bec_hits") == 0),
                   say("Advance-fee fraud / scam indicators detected: ", first3("fraud_hits")))))
    df = df.withColumns({"content_score": clamp(risk).cast("int"), "_factors": factors})
    primary = fusion.primary_category(F.col("categories"), F.col("content_score"))
    df = df.withColumn("primary_category", primary)
    headers = forwarded_by_header(F.col("raw_headers")) if "raw_headers" in have else F.lit(False)
    named = F.exists("_factors", lambda f: contains_any(F.lower(f), ["brand impersonation", "typosquatting"]))
    imitated = (number("registration_score") == 90) | (number("url_imitation_score") > 0)
    df = df.withColumns({
        "secondary_categories": fusion.secondary_categories(F.col("categories"), F.col("primary_category")),
        "risk_factors": F.when(F.size("_factors") > 0, F.col("_factors")).otherwise(
            F.array(F.lit("No content risk factors detected"))),
        "is_forwarded": F.col("forwarding.is_forwarded") | headers,
        "mimicry": named | imitated,
    })
    return df.drop("_body", "_subject", "_full", "_lower", "_urls", "_factors")


def triage(df: DataFrame, allow_verified: bool = False) -> DataFrame:
    """Content analysis, authentication and fusion: the verdict row of a message."""
    auth = F.col("authentication_results") if "authentication_results" in df.columns else F.lit("")
    out = analyse_content(df).withColumn("auth", parse_auth(auth))
    out = fusion.email_risk(out, allow_verified)
    return out.withColumn("summary", fusion.summary_line(F.col("verdict"), F.col("risk_factors")))


def signal_rows(analysed: DataFrame, key: str) -> DataFrame:
    """Fired rules as a long table ``key, signal, score`` (input of ``content_risk``)."""
    n = lambda c: F.size(c)
    row = lambda name, score: F.struct(F.lit(name).alias("signal"), score.alias("score"))
    fired = F.array(
        row("URL", F.col("url_signals.url_risk")),
        row("URGENCY", F.when(n("urgency_hits") > 0, F.least(F.lit(30) + n("urgency_hits") * 12, F.lit(90))).otherwise(0)),
        row("CREDENTIAL", F.when(n("credential_hits") > 0, 85).otherwise(0)),
        row("SPOOFING", F.col("spoof.score")),
        row("EXPOSURE", F.when(n("exposure_types") > 0, 95).otherwise(0)),
        row("BEC", F.when(n("bec_hits") > 0, 90).otherwise(0)),
        row("FRAUD", F.when((n("fraud_hits") > 0) & (n("bec_hits") == 0), 85).otherwise(0)))
    return analysed.select(key, F.explode(F.filter(fired, lambda s: s["score"] > 0)).alias("s")).select(key, "s.*")


def content_risk(signals: DataFrame, key: str) -> DataFrame:
    """Highest fired score and the fired rules per message."""
    return signals.groupBy(key).agg(
        F.max("score").alias("content_score"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"))
