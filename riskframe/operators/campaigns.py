"""Campaigns: connected cases, their summaries, orphan removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.correlation import confidence_rank, linkable, relation_of
from riskframe.operators.joins import lookup_join
from riskframe.session import checkpointed


def star_edges(indicators: DataFrame) -> DataFrame:
    """Each case of a value linked to the smallest case of that value.

    A value with n cases yields n - 1 edges, not n squared, and connects the
    same cases.
    """
    members = checkpointed(linkable(indicators).select("normalized_value", "case_id").distinct())
    hub = members.groupBy("normalized_value").agg(F.min("case_id").alias("hub"), F.count(F.lit(1)).alias("_n"))
    hub = hub.filter(F.col("_n") > 1).drop("_n")
    joined = lookup_join(members, hub, "normalized_value", "inner")
    return joined.filter(F.col("case_id") != F.col("hub")).select(
        F.col("case_id").alias("u"), F.col("hub").alias("v")).distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components as ``node, root`` (smallest node of the component).

    Alternates large-star and small-star steps; each is one aggregation and one
    join on the node, split where a node is a hub. Rounds grow with the
    logarithm of the component size. Raises if the rounds do not suffice, so a
    partial answer is never returned.
    """
    edges = checkpointed(edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = _signature(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = lookup_join(both, lowest, "u", "inner").filter(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.filter("u <> v").distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = lookup_join(large, lowest, "u", "inner")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            lowest.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.filter("u <> v").distinct())
        after = _signature(edges)
        if after == before:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                roots.select("node", F.col("node").alias("root")))
        before = after
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def campaigns(indicators: DataFrame, digits: int = 16) -> DataFrame:
    """Campaign membership: ``campaign_id, case_id, root_case``.

    One shared value is enough to join two cases. The id derives from the
    smallest member, so a rerun gives the same id; ``digits`` keeps ids of many
    campaigns apart.
    """
    found = components(star_edges(indicators))
    name = F.concat(F.lit("CMP-"), F.upper(F.substring(F.sha2(F.col("root"), 256), 1, digits)))
    return found.select(name.alias("campaign_id"), F.col("node").alias("case_id"), F.col("root").alias("root_case"))


def campaign_summary(members: DataFrame, cases: DataFrame, indicators: DataFrame) -> DataFrame:
    """Size, span and strongest shared indicator of each campaign.

    The primary indicator is the strongest kind, then the one most members
    share, then the smallest value.
    """
    seen = members.join(cases.select("case_id", "ts"), "case_id", "left").groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("member_case_count"), F.min("case_id").alias("first_member"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    _, confidence = relation_of(F.col("indicator_type"))
    used = (
        linkable(indicators).select("case_id", "normalized_value", "indicator_type").distinct()
        .join(members.select("case_id", "campaign_id"), "case_id")
        .groupBy("campaign_id", "normalized_value")
        .agg(F.countDistinct("case_id").alias("n"), F.max(confidence_rank(confidence)).alias("strength"))
        .filter(F.col("n") > 1))
    # max over (strength, n) with the smallest value on ties
    best = used.groupBy("campaign_id", "strength", "n").agg(F.min("normalized_value").alias("value")).groupBy(
        "campaign_id").agg(F.max_by(F.struct("value", "strength"), F.struct("strength", "n")).alias("_b"))
    return seen.join(best, "campaign_id", "left").select(
        "campaign_id", "member_case_count", "first_member", "first_seen", "last_seen",
        F.col("_b.value").alias("primary_ioc"),
        F.when(F.col("_b.strength") == 3, "HIGH").when(F.col("_b.strength") == 2, "MEDIUM").otherwise("LOW").alias("confidence"),
        F.concat(F.lit("Campaign "), F.substring(F.col("_b.value"), 1, 20)).alias("campaign_name"))


def drop_orphans(campaign_table: DataFrame, members: DataFrame) -> DataFrame:
    """Campaigns that still have a member."""
    return campaign_table.join(members.select("campaign_id").distinct(), "campaign_id", "left_semi")
