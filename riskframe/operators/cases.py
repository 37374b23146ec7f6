"""Case store operations as pure table transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.text import evidence_hash, mask_email, valid_case_id
from riskframe.operators.campaigns import drop_orphans
from riskframe.operators.enrichment import NOT_DETERMINABLE
from riskframe.operators.joins import top_n


def _contains(c: str, term: str) -> Column:
    """Case-insensitive literal containment; wildcards in the term mean themselves."""
    return F.coalesce(F.lower(F.col(c)).contains(term.strip().lower()), F.lit(False))


def search_cases(df: DataFrame, sender: str | None = None, domain: str | None = None, verdict: str | None = None,
                 category: str | None = None, query: str | None = None, limit: int | None = None) -> DataFrame:
    """Filtered cases, newest first, with masked senders."""
    out = df
    if sender:
        out = out.filter(_contains("sender", sender))
    if domain:
        out = out.filter(_contains("sender", "@" + domain.strip()))
    if verdict:
        out = out.filter(F.col("verdict") == verdict.strip().upper())
    if category:
        out = out.filter(F.col("primary_category") == category.strip().upper())
    if query:
        out = out.filter(_contains("subject", query) | _contains("sender", query) | _contains("case_id", query))
    out = out.orderBy(F.desc("ts"), "case_id")
    out = out.limit(limit) if limit is not None else out
    return out.withColumn("sender", mask_email(F.coalesce("sender", F.lit(""))))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest row per key over both tables (equal versions: the new table wins).

    ``max_by`` aggregates before the shuffle, so a key with many versions does
    not collect in one task.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_new"]
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_r"))
    return latest.select(*keys, "_r.*").select(*existing.columns)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows plus the new rows whose key is not there yet."""
    fresh = new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def purge(df: DataFrame, days: int, as_of: Column, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows to keep and rows past retention; rows without a time are kept."""
    expired = F.coalesce(F.col(ts) < as_of - F.make_dt_interval(F.lit(days)), F.lit(False))
    return df.filter(~expired), df.filter(expired)


def purge_case_tables(cases: DataFrame, indicators: DataFrame, members: DataFrame, days: int, as_of: Column):
    """Retention over the three case tables; membership of purged cases goes too."""
    kept, purged = purge(cases, days, as_of)
    kept_indicators, _ = purge(indicators, days, as_of)
    ids = purged.select("case_id")
    return kept, kept_indicators, members.join(ids, "case_id", "left_anti"), ids


def delete_cases(cases: DataFrame, indicators: DataFrame, members: DataFrame, campaign_table: DataFrame, ids: DataFrame):
    """Remove cases everywhere, then campaigns left without members.

    Ids of a wrong format are ignored.
    """
    gone = ids.filter(valid_case_id("case_id")).select("case_id").distinct()
    left = [t.join(gone, "case_id", "left_anti") for t in (cases, indicators, members)]
    return (*left, drop_orphans(campaign_table, left[2]))


def truncate(df: DataFrame) -> DataFrame:
    return df.limit(0)


def ioc_matrix(cases: DataFrame, url_scores: DataFrame, max_links: int | None = None) -> DataFrame:
    """Typed indicators of each case with the recommended action.

    ``cases``: case_id, sender, subject, ts_text, origin_ip, verdict;
    ``url_scores``: case_id, pos, url, domain, risk_score. Values are whole;
    ``shown`` is the shortened form of a printed report, and ``max_links``
    limits a report to the first links (off by default).
    """
    row = lambda kind, value, context, action: F.struct(
        F.lit(kind).alias("ioc_type"), value.alias("observable"), context.alias("context"), action.alias("action"))
    bad = F.col("verdict") == "MALICIOUS"
    sender, ip = F.coalesce("sender", F.lit("")), F.coalesce("origin_ip", F.lit(""))
    digest = evidence_hash("sender", "subject", "ts_text")
    own = cases.select("case_id", F.explode(F.array_compact(F.array(
        F.when(sender != "", row("EMAIL SENDER", sender, F.lit("Claimed envelope/header originator"),
                                 F.when(bad, "Filter / Gateway Quarantine").otherwise("Standard Logging"))),
        F.when((ip != "") & (ip != NOT_DETERMINABLE), row(
            "NETWORK IP", ip, F.lit("Chronological earliest observable public relay"),
            F.when(bad, "Perimeter Firewall / SIEM Block").otherwise("Traffic Logging"))),
        row("EVIDENCE HASH", digest,
            F.lit("SHA-256 cryptographic dossier integrity digest"), F.lit("Retain in DFIR Evidence Store")),
    ))).alias("r"))
    listed = url_scores if max_links is None else top_n(url_scores, ["case_id"], [F.col("pos")], max_links)
    links = listed.select("case_id", row(
        "EXTERNAL URL", F.col("url"),
        F.format_string("Domain: %s (Risk: %d)", F.col("domain"), F.col("risk_score")),
        F.when(F.col("risk_score") >= 50, "DNS Sinkhole / Web Proxy Block").otherwise("Monitor Web Gateway")).alias("r"))
    shown = F.when(F.col("ioc_type") == "EVIDENCE HASH", F.concat(F.substring("observable", 1, 32), F.lit("..."))).otherwise(F.substring("observable", 1, 50))
    return own.unionByName(links).select("case_id", "r.*").withColumn("shown", shown)
