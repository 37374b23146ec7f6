"""Queries over cases, indicators, campaigns and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.operators import campaigns as cp
from riskframe.operators import cases as cs
from riskframe.operators import correlation as co
from riskframe.operators import graph as gr
from riskframe.plans.datasets import (
    CASE_SQL, INDICATOR_SQL, LINK_SQL, case_verdicts, indicators, links, table,
)
from riskframe.plans.registry import query
from riskframe.plans.sqltext import in_list
from riskframe.session import checkpointed

_USABLE = f"""i AS ({INDICATOR_SQL}), c AS ({CASE_SQL}),
u AS (SELECT DISTINCT * FROM i WHERE normalized_value <> '' AND NOT {in_list('normalized_value', lx.UBIQUITOUS_VALUES)})"""
_RELATION = "CASE indicator_type " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, r, _ in lx.RELATION_TYPES) + f" ELSE '{lx.DEFAULT_RELATION[0]}' END"
_CONF = "CASE indicator_type " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, _, c in lx.RELATION_TYPES) + f" ELSE '{lx.DEFAULT_RELATION[1]}' END"
_RANK = "CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"
# Every pair of a value, ranked per indicator: the direct reading of the rule.
_PAIRS = f"""{_USABLE}, m AS (SELECT DISTINCT normalized_value, case_id FROM u),
p AS (SELECT u.case_id, u.indicator_type, u.indicator_value, u.normalized_value, m.case_id AS target_case_id,
  row_number() OVER (PARTITION BY u.case_id, u.indicator_type, u.indicator_value, u.normalized_value ORDER BY m.case_id) AS rn
  FROM u JOIN m ON u.normalized_value = m.normalized_value AND u.case_id <> m.case_id),
held AS (SELECT normalized_value, count(*) AS value_case_count FROM m GROUP BY 1),
rel AS (SELECT p.case_id, indicator_type, indicator_value, target_case_id, c.verdict AS target_verdict,
  {_RELATION} AS relationship_type, {_CONF} AS confidence, value_case_count
  FROM p JOIN held ON p.normalized_value = held.normalized_value LEFT JOIN c ON p.target_case_id = c.case_id WHERE rn <= 10)"""


@query("cross_case_correlation", f"WITH {_PAIRS} SELECT * FROM rel")
def cross_case_correlation(spark, sf):
    return co.correlate(indicators(spark, sf), case_verdicts(spark, sf)).drop("normalized_value", "explanation")


@query("attribution", f"""
WITH {_PAIRS}, t AS (SELECT case_id, target_case_id, max({_RANK}) AS k FROM rel GROUP BY 1, 2),
n AS (SELECT case_id, count(*) AS cnt, max(k) AS best, array_to_string(list_sort(list(target_case_id))[1:10], ',') AS related FROM t GROUP BY 1)
SELECT c.case_id, coalesce(cnt, 0) AS related_case_count, coalesce(related, '') AS related_cases,
  CASE best WHEN 3 THEN 'REPEATED_THREAT_INFRASTRUCTURE_CONFIRMED' WHEN 2 THEN 'RELATED_DOMAIN_CLUSTER_INDICATED'
    WHEN 1 THEN 'WEAK_BEHAVIORAL_CORRELATION' ELSE 'ISOLATED_INCIDENT' END AS attribution_assessment,
  CASE best WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS attribution_confidence FROM c LEFT JOIN n ON c.case_id = n.case_id""")
def attribution(spark, sf):
    cases = case_verdicts(spark, sf)
    out = co.assess_attribution(co.correlate(indicators(spark, sf), cases), cases)
    return out.withColumn("related_cases", F.array_join("related_cases", ","))


@query("top_relations", f"""
WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {_RANK} DESC, target_case_id, indicator_type, indicator_value) AS rank FROM rel)
SELECT case_id, target_case_id, relationship_type, confidence, rank FROM r WHERE rank <= 15""")
def top_relations(spark, sf):
    rel = co.correlate(indicators(spark, sf), case_verdicts(spark, sf))
    return co.top_relations(rel).select("case_id", "target_case_id", "relationship_type", "confidence", "rank")


_CASES_LIST = f"""k AS (SELECT case_id, ts, sender, CASE WHEN len(case_id) % 2 = 0 THEN concat('8.8.4.', risk_score) ELSE 'ORIGIN_NOT_DETERMINABLE' END AS ip,
  CASE WHEN risk_score % 2 = 0 THEN concat('host', risk_score, '.example.com') END AS d1, 'Shop.Example.org/' AS d2, CASE WHEN risk_score % 5 = 0 THEN sha256(case_id) END AS hash FROM ({CASE_SQL}))"""


@query("indicator_index", f"""
WITH {_CASES_LIST}, r AS (
  SELECT case_id, 'sender_email' AS indicator_type, sender AS v, lower(trim(sender)) AS n FROM k
  UNION ALL SELECT case_id, 'sender_domain', split_part(sender, '@', 2), lower(split_part(sender, '@', 2)) FROM k WHERE contains(sender, '@')
  UNION ALL SELECT case_id, 'origin_ip', ip, ip FROM k WHERE ip <> 'ORIGIN_NOT_DETERMINABLE'
  UNION ALL SELECT case_id, 'url_domain', d1, d1 FROM k UNION ALL SELECT case_id, 'url_domain', d2, 'shop.example.org' FROM k
  UNION ALL SELECT case_id, 'attachment_hash', hash, hash FROM k)
SELECT case_id, indicator_type, v AS indicator_value, n AS normalized_value FROM r WHERE coalesce(v, '') <> ''""")
def indicator_index(spark, sf):
    k = case_verdicts(spark, sf).withColumns({
        "origin_ip": F.expr("CASE WHEN length(case_id) % 2 = 0 THEN concat('8.8.4.', CAST(risk_score AS STRING)) ELSE 'ORIGIN_NOT_DETERMINABLE' END"),
        "url_domains": F.expr("array(CASE WHEN risk_score % 2 = 0 THEN concat('host', CAST(risk_score AS STRING), '.example.com') END, 'Shop.Example.org/')"),
        "attachment_hashes": F.expr("array(CASE WHEN risk_score % 5 = 0 THEN sha2(case_id, 256) END)")})
    return co.index_indicators(k).drop("ts")


# -- campaigns -------------------------------------------------------------

# Smallest reachable case by repeated relaxation over the shared values.
_ROOTS = f"""{_USABLE}, m AS (SELECT DISTINCT normalized_value AS v, case_id FROM u),
s AS (SELECT * FROM m WHERE v IN (SELECT v FROM m GROUP BY v HAVING count(*) > 1)),
e AS (SELECT DISTINCT s.case_id AS a, h.hub AS b FROM s JOIN (SELECT v, min(case_id) AS hub FROM s GROUP BY v) h USING (v)),
b2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w(node, root) AS (SELECT a, a FROM b2 UNION SELECT b2.b, w.root FROM w JOIN b2 ON w.node = b2.a),
comp AS (SELECT node AS case_id, min(root) AS root_case FROM w GROUP BY 1)"""


@query("campaigns", f"""
WITH RECURSIVE {_ROOTS} SELECT concat('CMP-', upper(left(sha256(root_case), 16))) AS campaign_id, case_id, root_case FROM comp""")
def campaign_members(spark, sf):
    return cp.campaigns(indicators(spark, sf))


@query("campaign_summary", f"""
WITH RECURSIVE {_ROOTS}, mem AS (SELECT concat('CMP-', upper(left(sha256(root_case), 16))) AS campaign_id, case_id FROM comp),
seen AS (SELECT campaign_id, count(*) AS member_case_count, min(mem.case_id) AS first_member, min(ts) AS a, max(ts) AS z FROM mem JOIN c ON mem.case_id = c.case_id GROUP BY 1),
used AS (SELECT campaign_id, normalized_value, count(DISTINCT u.case_id) AS n, max({_RANK.replace('confidence', '(' + _CONF + ')')}) AS k FROM mem JOIN u ON mem.case_id = u.case_id GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY k DESC, n DESC, normalized_value) AS rn FROM used WHERE n > 1)
SELECT seen.campaign_id, member_case_count, first_member, epoch(a)::BIGINT AS first_seen, epoch(z)::BIGINT AS last_seen, normalized_value AS primary_ioc,
  CASE k WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, concat('Campaign ', left(normalized_value, 20)) AS campaign_name
FROM seen JOIN best ON seen.campaign_id = best.campaign_id AND rn = 1""")
def campaign_summary(spark, sf):
    ind = checkpointed(indicators(spark, sf))
    out = cp.campaign_summary(cp.campaigns(ind), case_verdicts(spark, sf), ind)
    return out.withColumns({"first_seen": F.unix_timestamp("first_seen"), "last_seen": F.unix_timestamp("last_seen")})


@query("orphan_campaigns", """
SELECT c_custkey AS campaign_id, c_name AS campaign_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def orphan_campaigns(spark, sf):
    camps = table(spark, sf, "customer").select(F.col("c_custkey").alias("campaign_id"), F.col("c_name").alias("campaign_name"))
    members = table(spark, sf, "orders").select(F.col("o_custkey").alias("campaign_id"), F.col("o_orderkey").alias("case_id"))
    return cp.drop_orphans(camps, members)


_GRAPH = f"""
WITH RECURSIVE {_ROOTS}, m2 AS (SELECT DISTINCT normalized_value, case_id FROM u),
pr AS (SELECT u.case_id, u.indicator_type, u.indicator_value, m2.case_id AS target_case_id,
  row_number() OVER (PARTITION BY u.case_id, u.indicator_type, u.indicator_value, u.normalized_value ORDER BY m2.case_id) AS rn
  FROM u JOIN m2 ON u.normalized_value = m2.normalized_value AND u.case_id <> m2.case_id),
rl AS (SELECT case_id, target_case_id, row_number() OVER (PARTITION BY case_id ORDER BY CASE {_CONF} WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC,
  target_case_id, indicator_type, indicator_value) AS k FROM pr WHERE rn <= 10),
near AS (SELECT case_id, count(DISTINCT target_case_id) AS n, count(*) AS e FROM rl WHERE k <= 6 GROUP BY 1),
ip AS (SELECT case_id, 1 AS n FROM i WHERE indicator_type = 'origin_ip' GROUP BY 1),
ur AS (SELECT case_id, count(*) AS n FROM i WHERE indicator_type = 'url_domain' AND normalized_value <> '' GROUP BY 1),
fl AS (SELECT case_id, count(*) AS n FROM i WHERE indicator_type = 'attachment_hash' GROUP BY 1),
cm AS (SELECT case_id, 1 AS n FROM comp)
SELECT c.case_id, 1 + 2 * CAST(c.sender <> '' AS INT) + coalesce(ip.n, 0) + coalesce(ur.n, 0) + coalesce(fl.n, 0) + coalesce(cm.n, 0) + coalesce(near.n, 0) AS node_count,
  2 * CAST(c.sender <> '' AS INT) + coalesce(ip.n, 0) + coalesce(ur.n, 0) + coalesce(fl.n, 0) + coalesce(cm.n, 0) + coalesce(near.e, 0) AS edge_count
FROM c LEFT JOIN ip USING (case_id) LEFT JOIN ur USING (case_id) LEFT JOIN fl USING (case_id) LEFT JOIN cm USING (case_id) LEFT JOIN near USING (case_id)"""


@query("case_graph", _GRAPH)
def case_graph(spark, sf):
    ind, cases = checkpointed(indicators(spark, sf)), case_verdicts(spark, sf)  # read six times below
    rel = co.correlate(ind, cases)
    mem = cp.campaigns(ind).withColumns({"campaign_name": F.lit(None).cast("string"), "confidence": F.lit("HIGH")})
    first_ip = ind.filter("indicator_type = 'origin_ip'").groupBy("case_id").agg(F.min("normalized_value").alias("origin_ip"))
    urls = ind.filter("indicator_type = 'url_domain'").select("case_id", F.lit(0).alias("pos"), F.col("normalized_value").alias("domain"))
    files = ind.filter("indicator_type = 'attachment_hash'").select(
        "case_id", F.lit(0).alias("pos"), F.lit("message.txt").alias("filename"), F.col("normalized_value").alias("sha256"))
    nodes, edges = gr.case_graph(cases.join(first_ip, "case_id", "left"), urls, files, mem, rel)
    return gr.graph_counts(nodes, edges)


# -- case store ------------------------------------------------------------

_MASK = "CASE WHEN contains(sender, '@') THEN concat(left(sender, 1), '***@', split_part(sender, '@', 2)) ELSE sender END"


@query("case_search", f"""
SELECT case_id, {_MASK} AS sender, subject, verdict, risk_score FROM ({CASE_SQL})
WHERE contains(lower(sender), '@mail3') AND verdict = 'MALICIOUS' AND contains(lower(subject), 'review_')
ORDER BY ts DESC, case_id LIMIT 50""")
def case_search(spark, sf):
    out = cs.search_cases(case_verdicts(spark, sf), domain="Mail3", verdict="malicious", query="review_", limit=50)
    return out.select("case_id", "sender", "subject", "verdict", "risk_score")


@query("case_upsert", """
WITH a AS (SELECT o_custkey AS case_id, o_orderkey AS version, o_orderstatus AS verdict FROM orders)
SELECT case_id, max(version) AS version, max_by(verdict, version) AS verdict FROM a GROUP BY 1""")
def case_upsert(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("verdict"))
    return cs.upsert(rows.filter("version % 2 = 0"), rows.filter("version % 2 = 1"), ["case_id"], "version")


@query("membership_insert", """
SELECT DISTINCT l_suppkey AS campaign_id, l_partkey AS case_id FROM lineitem""")
def membership_insert(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("campaign_id"), F.col("l_partkey").alias("case_id"), "l_linenumber")
    old = rows.filter("l_linenumber <= 2").select("campaign_id", "case_id").distinct()
    return cs.insert_ignore(old, rows.filter("l_linenumber > 2").select("campaign_id", "case_id"), ["campaign_id", "case_id"])


@query("retention_purge", f"""
SELECT 'kept' AS part, count(*) AS n, min(case_id) AS first_id FROM ({CASE_SQL}) WHERE ts >= TIMESTAMP '2024-02-20 00:00:00' - INTERVAL 30 DAY
UNION ALL SELECT 'purged', count(*), min(case_id) FROM ({CASE_SQL}) WHERE ts < TIMESTAMP '2024-02-20 00:00:00' - INTERVAL 30 DAY""")
def retention_purge(spark, sf):
    kept, purged = cs.purge(case_verdicts(spark, sf), 30, F.to_timestamp(F.lit("2024-02-20 00:00:00")))
    count = lambda df, part: df.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), F.min("case_id").alias("first_id"))
    return count(kept, "kept").union(count(purged, "purged"))


@query("case_delete", f"""
WITH {_USABLE}, gone AS (SELECT case_id FROM c WHERE risk_score % 10 = 0 AND len(case_id) >= 3)
SELECT 'cases' AS part, count(*) AS n FROM c WHERE case_id NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'indicators', count(*) FROM i WHERE case_id NOT IN (SELECT * FROM gone)""")
def case_delete(spark, sf):
    cases, ind = case_verdicts(spark, sf), indicators(spark, sf)
    members = ind.filter("indicator_type = 'url_domain'").select(F.col("normalized_value").alias("campaign_id"), "case_id")
    gone = cases.filter("risk_score % 10 = 0").select("case_id")
    left = cs.delete_cases(cases, ind, members, members.select("campaign_id").distinct(), gone)
    count = lambda df, part: df.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(left[0], "cases").union(count(left[1], "indicators"))


@query("ioc_matrix", f"""
WITH c AS (SELECT case_id, sender, subject, verdict, CASE WHEN risk_score % 3 = 0 THEN '' ELSE '8.8.8.8' END AS ip FROM ({CASE_SQL})),
l AS (SELECT concat('P', link_id % 1000000000) AS case_id, url, link_id FROM ({LINK_SQL}))
SELECT case_id, 'EMAIL SENDER' AS ioc_type, sender AS observable, CASE WHEN verdict = 'MALICIOUS' THEN 'Filter / Gateway Quarantine' ELSE 'Standard Logging' END AS action FROM c WHERE sender <> ''
UNION ALL SELECT case_id, 'NETWORK IP', ip, CASE WHEN verdict = 'MALICIOUS' THEN 'Perimeter Firewall / SIEM Block' ELSE 'Traffic Logging' END FROM c WHERE ip <> ''
UNION ALL SELECT case_id, 'EVIDENCE HASH', sha256(concat(sender, ':', subject, ':', 't0')), 'Retain in DFIR Evidence Store' FROM c
UNION ALL SELECT case_id, 'EXTERNAL URL', url, 'Monitor Web Gateway' FROM l""")
def ioc_matrix(spark, sf):
    cases = case_verdicts(spark, sf).withColumns({
        "origin_ip": F.expr("CASE WHEN risk_score % 3 = 0 THEN '' ELSE '8.8.8.8' END"), "ts_text": F.lit("t0")})
    urls = links(spark, sf).select(
        F.concat(F.lit("P"), (F.col("link_id") % 1000000000).cast("string")).alias("case_id"), F.col("link_id").alias("pos"), "url",
        F.lit("d").alias("domain"), F.lit(10).alias("risk_score"))
    return cs.ioc_matrix(cases, urls).drop("context", "shown")
