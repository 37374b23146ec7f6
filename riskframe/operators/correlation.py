"""Cross-case correlation: indicators, matches, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.functions.text import normalize_indicator
from riskframe.operators.enrichment import NOT_DETERMINABLE
from riskframe.operators.joins import lookup_join, top_n
from riskframe.session import checkpointed

CONFIDENCE_RANK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


def index_indicators(cases: DataFrame) -> DataFrame:
    """Five kinds of indicator of each case as rows.

    Needs ``case_id, ts, sender, origin_ip, url_domains, attachment_hashes``
    (the last two arrays). Empty values and undeterminable origins are dropped.
    One pass over the cases, no shuffle.
    """
    sender = F.coalesce(F.col("sender"), F.lit(""))
    domain = F.trim(F.btrim(F.substring_index(sender, "@", -1), F.lit(">")))
    one = lambda kind, value: F.struct(F.lit(kind).alias("t"), value.alias("v"))
    empty = F.array().cast("array<string>")
    many = lambda kind, c: F.transform(F.coalesce(F.col(c), empty), lambda v: one(kind, v))
    rows = F.concat(
        F.array(
            one("sender_email", sender),
            one("sender_domain", F.when(sender.contains("@"), domain)),
            one("origin_ip", F.when(F.col("origin_ip") != NOT_DETERMINABLE, F.col("origin_ip")))),
        many("url_domain", "url_domains"), many("attachment_hash", "attachment_hashes"))
    kept = F.filter(rows, lambda r: F.coalesce(r["v"], F.lit("")) != "")
    out = cases.select("case_id", "ts", F.explode(kept).alias("r"))
    return out.select(
        "case_id", F.col("r.t").alias("indicator_type"), F.col("r.v").alias("indicator_value"),
        normalize_indicator(F.col("r.t"), F.col("r.v")).alias("normalized_value"), "ts")


def linkable(indicators: DataFrame) -> DataFrame:
    """Indicators that may link cases: no empty and no ubiquitous values."""
    value = F.col("normalized_value")
    return indicators.filter(value.isNotNull() & (value != "") & ~value.isin(lx.UBIQUITOUS_VALUES))


def relation_of(kind: Column) -> tuple[Column, Column]:
    relation, confidence = None, None
    for name, rel, conf in lx.RELATION_TYPES:
        relation = F.when(kind == name, rel) if relation is None else relation.when(kind == name, rel)
        confidence = F.when(kind == name, conf) if confidence is None else confidence.when(kind == name, conf)
    return relation.otherwise(lx.DEFAULT_RELATION[0]), confidence.otherwise(lx.DEFAULT_RELATION[1])


def explain_relation(kind: Column, raw: Column, value: Column, target: Column) -> Column:
    say = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    return (
        F.when(kind == "attachment_hash", say(
            "Identical malicious attachment SHA-256 payload (", F.substring(value, 1, 12), "...) identified in case ", target, "."))
        .when(kind == "origin_ip", say(
            "Same earliest reliable observed infrastructure IP (", raw, ") used in case ", target, "."))
        .when(kind == "sender_domain", say("Shared sending domain (", raw, ") observed in case ", target, "."))
        .when(kind == "url_domain", say("Shared landing/phishing URL domain (", raw, ") referenced in case ", target, "."))
        .otherwise(say("Shared ", kind, " indicator (", raw, ") linked to case ", target, ".")))


def correlate(indicators: DataFrame, cases: DataFrame, per_indicator: int = 10) -> DataFrame:
    """For every indicator the first ``per_indicator`` other cases that share its value.

    The order is by case id. Every indicator of a value looks at the same
    ``per_indicator + 1`` first cases, so those are ranked and packed once per
    value and joined back; no pairs inside a value are ever formed. The type
    of the indicator need not match. ``cases`` gives ``verdict`` by ``case_id``.
    ``value_case_count`` is the exact number of all cases that hold the value.
    """
    # Written once: ranked, counted for hot values and joined below.
    usable = checkpointed(linkable(indicators).select(
        "case_id", "indicator_type", "indicator_value", "normalized_value").distinct())
    members = usable.select("normalized_value", "case_id").distinct()
    first = top_n(members, ["normalized_value"], [F.col("case_id")], per_indicator + 1)
    first = first.join(cases.select("case_id", "verdict"), "case_id", "left")
    totals = members.groupBy("normalized_value").agg(F.count(F.lit(1)).alias("value_case_count"))
    packed = (
        first.groupBy("normalized_value")
        .agg(F.array_sort(F.collect_list(F.struct(
            "rank", F.col("case_id").alias("target_case_id"),
            F.coalesce("verdict", F.lit("UNKNOWN")).alias("target_verdict")))).alias("_others"))
        .filter(F.size("_others") > 1)).join(totals, "normalized_value")
    joined = lookup_join(usable, packed, "normalized_value", "inner")
    others = F.slice(F.filter("_others", lambda o: o["target_case_id"] != F.col("case_id")), 1, per_indicator)
    out = joined.withColumn("_o", F.explode(others)).select(
        "case_id", "indicator_type", "indicator_value", "normalized_value", "_o.target_case_id", "_o.target_verdict", "value_case_count")
    relation, confidence = relation_of(F.col("indicator_type"))
    return out.withColumns({
        "relationship_type": relation, "confidence": confidence,
        "explanation": explain_relation(
            F.col("indicator_type"), F.col("indicator_value"), F.col("normalized_value"), F.col("target_case_id"))})


def confidence_rank(c: Column) -> Column:
    chain = None
    for name, rank in CONFIDENCE_RANK.items():
        chain = F.when(c == name, rank) if chain is None else chain.when(c == name, rank)
    return chain.otherwise(0)


def relation_order() -> list[Column]:
    return [confidence_rank(F.col("confidence")).desc(), F.col("target_case_id"), F.col("indicator_type"),
            F.col("indicator_value")]


def top_relations(relations: DataFrame, n: int = 15) -> DataFrame:
    """The strongest ``n`` relations per case, ties by target and indicator."""
    return top_n(relations, ["case_id"], relation_order(), n)


def assess_attribution(relations: DataFrame, cases: DataFrame, related: int = 10) -> DataFrame:
    """Attribution support per case; cases without relations are isolated."""
    pairs = relations.groupBy("case_id", "target_case_id").agg(F.max(confidence_rank(F.col("confidence"))).alias("_c"))
    totals = pairs.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("related_case_count"), F.max("_c").alias("_best"))
    named = top_n(pairs, ["case_id"], [F.col("target_case_id")], related).groupBy("case_id").agg(
        F.array_sort(F.collect_list("target_case_id")).alias("related_cases"))
    out = cases.select("case_id").distinct().join(totals, "case_id", "left").join(named, "case_id", "left")
    best = F.coalesce(F.col("_best"), F.lit(0))
    return out.select(
        "case_id", F.coalesce("related_case_count", F.lit(0)).alias("related_case_count"),
        F.coalesce("related_cases", F.array().cast("array<string>")).alias("related_cases"),
        F.when(best == 3, lx.ATTRIBUTION["HIGH"]).when(best == 2, lx.ATTRIBUTION["MEDIUM"])
        .when(best == 1, lx.ATTRIBUTION["LOW"]).otherwise(lx.ATTRIBUTION["NONE"]).alias("attribution_assessment"),
        F.when(best == 3, "HIGH").when(best == 2, "MEDIUM").otherwise("LOW").alias("attribution_confidence"))
