"""Investigation graphs of cases and reachability over object references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.text import mask_email
from riskframe.operators.correlation import top_relations
from riskframe.operators.enrichment import NOT_DETERMINABLE
from riskframe.operators.joins import top_n
from riskframe.session import checkpointed

MAX_NODES, MAX_EDGES = 50, 80


def case_graph(cases: DataFrame, urls: DataFrame, attachments: DataFrame, members: DataFrame,
               relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around each case.

    ``cases``: case_id, sender, origin_ip; ``urls``: case_id, pos, domain;
    ``attachments``: case_id, pos, filename, sha256; ``members``: case_id,
    campaign_id, campaign_name, confidence; ``relations``: ``correlate``.
    The report shows up to 5 links, 3 attachments and 6 related cases per case
    and 50 nodes and 80 edges in all.
    """
    case_node = F.concat(F.lit("case:"), F.col("case_id"))
    sender = F.coalesce(F.col("sender"), F.lit(""))
    mailbox = F.concat(F.lit("sender:"), F.lower(sender))
    domain = F.lower(F.trim(F.btrim(F.substring_index(sender, "@", -1), F.lit(">"))))

    def item(ordinal, source, node, kind, label, masked, rel, conf) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(
            F.lit(ordinal).alias("ordinal") if not isinstance(ordinal, Column) else ordinal.alias("ordinal"),
            lit(source).cast("string").alias("source"), node.alias("node_id"), F.lit(kind).alias("node_type"),
            label.alias("label"), lit(masked).alias("masked_label"), lit(rel).cast("string").alias("relationship"),
            lit(conf).cast("string").alias("confidence"))

    has_ip = F.col("origin_ip").isNotNull() & (F.col("origin_ip") != NOT_DETERMINABLE) & (F.col("origin_ip") != "")
    base = cases.select("case_id", F.explode(F.array_compact(F.array(
        item(0, None, case_node, "CASE", F.col("case_id"), F.col("case_id"), None, None),
        F.when(sender != "", item(1, case_node, mailbox, "SENDER", sender, mask_email(sender), "SENT_BY", "HIGH")),
        F.when(sender.contains("@"), item(2, mailbox, F.concat(F.lit("domain:"), domain), "DOMAIN", domain, domain, "USES_DOMAIN", "HIGH")),
        F.when(has_ip, item(3, case_node, F.concat(F.lit("ip:"), F.col("origin_ip")), "IP", F.col("origin_ip"),
                            F.col("origin_ip"), "ROUTED_THROUGH", "HIGH")),
    ))).alias("x"))
    links = top_n(urls, ["case_id"], [F.col("pos")], 5).filter(F.coalesce("domain", F.lit("")) != "").select(
        "case_id", item(F.col("rank") + 9, case_node, F.concat(F.lit("url_domain:"), F.lower("domain")), "URL",
                        F.col("domain"), F.col("domain"), "CONTAINS_URL", "HIGH").alias("x"))
    files = top_n(attachments, ["case_id"], [F.col("pos")], 3).filter(F.coalesce("sha256", F.lit("")) != "")
    name = F.coalesce(F.when(F.col("filename") != "", F.col("filename")), F.lit("attachment"))
    files = files.select("case_id", item(
        F.col("rank") + 19, case_node, F.concat(F.lit("attachment:"), F.substring("sha256", 1, 16)), "ATTACHMENT",
        name, name, "HAS_ATTACHMENT", "HIGH").alias("x"))
    title = F.coalesce(F.col("campaign_name"), F.col("campaign_id"))
    camps = members.select("case_id", item(
        30, case_node, F.concat(F.lit("campaign:"), F.col("campaign_id")), "CAMPAIGN", title, title,
        "MEMBER_OF_CAMPAIGN", F.coalesce(F.col("confidence"), F.lit("MEDIUM"))).alias("x"))
    target = F.col("target_case_id")
    near = top_relations(relations, 6).select("case_id", item(
        F.col("rank") + 39, case_node, F.concat(F.lit("case:"), target), "CASE", target, target,
        F.col("relationship_type"), F.col("confidence")).alias("x"))
    items = base
    for part in (links, files, camps, near):
        items = items.unionByName(part)
    items = items.select("case_id", "x.*")
    items = checkpointed(items)
    # At most 4 + 5 + 3 + 6 items and the campaigns of a case reach this window.
    once = top_n(items, ["case_id", "node_id"], [F.col("ordinal")], 1, "_first")
    nodes = top_n(once, ["case_id"], [F.col("ordinal"), F.col("node_id")], MAX_NODES, "node_rank").select(
        "case_id", "node_id", "node_type", "label", "masked_label", "node_rank")
    admitted = nodes.select("case_id", F.col("node_id").alias("_n"))
    ends = items.filter(F.col("source").isNotNull())
    ends = ends.join(admitted, (ends["case_id"] == admitted["case_id"]) & (ends["node_id"] == admitted["_n"]), "left_semi")
    ends = ends.join(admitted, (ends["case_id"] == admitted["case_id"]) & (ends["source"] == admitted["_n"]), "left_semi")
    edges = top_n(ends, ["case_id"], [F.col("ordinal"), F.col("node_id")], MAX_EDGES, "edge_rank").select(
        "case_id", "source", F.col("node_id").alias("target"), "relationship", "confidence", "edge_rank")
    return nodes, edges


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("case_id").agg(F.count(F.lit(1)).alias("node_count"))
    e = edges.groupBy("case_id").agg(F.count(F.lit(1)).alias("edge_count"))
    return n.join(e, "case_id", "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))


def reachable(roots: DataFrame, refs: DataFrame) -> DataFrame:
    """All ``(file_id, obj_key)`` reachable from the roots over ``(file_id, obj_key, target)``.

    Breadth-first over all files at once, until a round finds nothing new; a round joins only the newly found objects.
    What was found is kept in tables of doubling age, two of an age being merged, so a row is written again at most once
    for each doubling of the rounds, and a round reads as many tables as that.
    """
    key = ["file_id", "obj_key"]
    parts = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    refs = checkpointed(refs.select(*key, "target").distinct())
    front = checkpointed(roots.select(*key).distinct())
    found = [(0, front)]
    while True:
        seen = found[0][1]
        for _, more in found[1:]:
            seen = seen.union(more)
        step = front.join(refs, key).select("file_id", F.col("target").alias("obj_key")).distinct()
        front = checkpointed(step.join(seen, key, "left_anti"))
        if front.isEmpty():
            return seen
        found.append((0, front))
        while len(found) > 1 and found[-1][0] == found[-2][0]:
            (age, older), (_, newer) = found[-2:]
            found[-2:] = [(age + 1, checkpointed(older.union(newer).coalesce(parts)))]
