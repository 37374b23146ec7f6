from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskframe.operators import campaigns as cp
from riskframe.operators import cases as cs
from riskframe.operators import correlation as co
from riskframe.operators import graph as gr

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def cases(spark):
    rows = [("A", T0, "x@evil.com", "198.51.100.45", ["bad.example.com"], ["h1"], "MALICIOUS"),
            ("B", T0 + timedelta(days=1), "Eve <eve@other.com>", "198.51.100.45", ["bad.example.com"], [], "SUSPICIOUS"),
            ("C", T0 + timedelta(days=2), "u1@gmail.com", "ORIGIN_NOT_DETERMINABLE", [], [], "SAFE"),
            ("D", T0 + timedelta(days=3), "u2@gmail.com", None, [], [], "SAFE"),
            ("E", T0 + timedelta(days=4), "z@other.com", None, [], [], "SAFE")]
    return spark.createDataFrame(rows, "case_id string, ts timestamp, sender string, origin_ip string, url_domains array<string>, attachment_hashes array<string>, verdict string")


def test_correlation_and_attribution(cases):
    ind = co.index_indicators(cases)
    rel = co.correlate(ind, cases)
    got = {r["case_id"]: r for r in co.assess_attribution(rel, cases).collect()}
    assert got["A"]["attribution_confidence"] == "HIGH" and got["A"]["related_cases"] == ["B"]
    assert got["A"]["attribution_assessment"] == "REPEATED_THREAT_INFRASTRUCTURE_CONFIRMED"
    assert got["C"]["related_case_count"] == 0 and got["C"]["attribution_assessment"] == "ISOLATED_INCIDENT"
    assert got["E"]["attribution_confidence"] == "MEDIUM" and got["E"]["related_cases"] == ["B"]


def test_correlation_limit_per_indicator(spark):
    ind = spark.createDataFrame([(f"c{i:03d}", "origin_ip", "8.8.8.8", "8.8.8.8") for i in range(200)],
                                "case_id string, indicator_type string, indicator_value string, normalized_value string")
    cases = ind.select("case_id", F.lit("SAFE").alias("verdict"))
    per = co.correlate(ind, cases).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.min("target_case_id").alias("m"))
    assert {r["n"] for r in per.collect()} == {10}
    assert per.filter("case_id = 'c000'").first()["m"] == "c001"


def test_correlation_counts_all_cases_of_a_value(spark):
    ind = spark.createDataFrame([(f"c{i:03d}", "origin_ip", "8.8.8.8", "8.8.8.8") for i in range(200)],
                                "case_id string, indicator_type string, indicator_value string, normalized_value string")
    rel = co.correlate(ind, ind.select("case_id", F.lit("SAFE").alias("verdict")))
    assert {r["value_case_count"] for r in rel.collect()} == {200}


def test_components_match_union_find(spark):
    import random
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(220)]
    pairs += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {n: find(n) for p in pairs if p[0] != p[1] for n in p}
    got = {r["node"]: r["root"] for r in cp.components(spark.createDataFrame(pairs, "u string, v string")).collect()}
    assert got == want


def test_campaigns_are_a_partition(cases):
    ind = co.index_indicators(cases)
    mem = cp.campaigns(ind).collect()
    assert len({r["case_id"] for r in mem}) == len(mem)
    assert {r["case_id"] for r in mem} == {"A", "B", "E"} and len({r["campaign_id"] for r in mem}) == 1
    s = cp.campaign_summary(cp.campaigns(ind), cases, ind).first()
    assert s["member_case_count"] == 3 and s["primary_ioc"] == "198.51.100.45" and s["confidence"] == "HIGH"


def test_graph_bounds_and_masks(spark, cases):
    ind = co.index_indicators(cases)
    urls = spark.createDataFrame([("A", i, f"h{i}.com") for i in range(100)], "case_id string, pos int, domain string")
    files = spark.createDataFrame([("A", i, f"f{i}", f"{i:064d}"[::-1]) for i in range(5)], "case_id string, pos int, filename string, sha256 string")
    mem = cp.campaigns(ind).withColumns({"campaign_name": F.lit("x"), "confidence": F.lit("HIGH")})
    nodes, edges = gr.case_graph(cases, urls, files, mem, co.correlate(ind, cases))
    counts = {r["case_id"]: r for r in gr.graph_counts(nodes, edges).collect()}
    assert counts["A"]["node_count"] <= 50 and counts["A"]["edge_count"] <= 80
    kinds = {r["node_type"]: r["count"] for r in nodes.filter("case_id = 'A'").groupBy("node_type").count().collect()}
    assert kinds == {"CASE": 2, "SENDER": 1, "DOMAIN": 1, "IP": 1, "URL": 5, "ATTACHMENT": 3, "CAMPAIGN": 1}
    assert nodes.filter("case_id = 'A' and node_type = 'SENDER'").first()["masked_label"] == "***@evil.com"
    loose = edges.join(nodes, (edges["case_id"] == nodes["case_id"]) & (edges["target"] == nodes["node_id"]), "left_anti")
    assert loose.isEmpty()


def test_reachability_handles_cycles(spark):
    refs = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "b", "c"), (1, "x", "y"), (2, "a", "z")], "file_id int, obj_key string, target string")
    roots = spark.createDataFrame([(1, "a")], "file_id int, obj_key string")
    assert {tuple(r) for r in gr.reachable(roots, refs).collect()} == {(1, "a"), (1, "b"), (1, "c")}


def test_store_operations(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "case_id string, version int, verdict string")
    new = spark.createDataFrame([("a", 1, "z"), ("b", 2, "w"), ("c", 1, "v")], "case_id string, version int, verdict string")
    got = {r["case_id"]: r["verdict"] for r in cs.upsert(old, new, ["case_id"], "version").collect()}
    assert got == {"a": "z", "b": "y", "c": "v"}
    assert cs.insert_ignore(old, new, ["case_id"]).count() == 3
    assert cs.truncate(old).count() == 0


def test_purge_partitions_the_table(spark, cases):
    kept, purged = cs.purge(cases, 2, F.lit(T0 + timedelta(days=4)))
    assert kept.count() + purged.count() == cases.count()
    assert {r["case_id"] for r in purged.collect()} == {"A", "B"}
    ind = co.index_indicators(cases)
    mem = cp.campaigns(ind).select("campaign_id", "case_id")
    k, i, m, ids = cs.purge_case_tables(cases, ind, mem, 2, F.lit(T0 + timedelta(days=4)))
    assert {r["case_id"] for r in m.collect()} == {"E"} and ids.count() == 2 and i.filter("case_id in ('A','B')").isEmpty()


def test_delete_cleans_orphans(spark, cases):
    ind = co.index_indicators(cases)
    mem = spark.createDataFrame([("k1", "A"), ("k2", "B"), ("k2", "C")], "campaign_id string, case_id string")
    camps = spark.createDataFrame([("k1",), ("k2",)], "campaign_id string")
    gone = spark.createDataFrame([("A",), ("bad id!",)], "case_id string")
    c, _, m, left = cs.delete_cases(cases.withColumn("case_id", F.concat(F.lit("CASE-"), "case_id")), ind, mem, camps, gone)
    assert c.count() == 5 and left.count() == 2  # 'A' is too short for a valid id
    gone = spark.createDataFrame([("CASE-A",)], "case_id string")
    mem = mem.withColumn("case_id", F.concat(F.lit("CASE-"), "case_id"))
    c, _, m, left = cs.delete_cases(cases.withColumn("case_id", F.concat(F.lit("CASE-"), "case_id")), ind, mem, camps, gone)
    assert c.count() == 4 and [r["campaign_id"] for r in left.collect()] == ["k2"]


def test_search_treats_wildcards_as_text(spark):
    df = spark.createDataFrame([("c1", T0, "bob@x.com", "50%_off", "MALICIOUS", 90, "BEC"), ("c2", T0, "al@y.com", "500 off", "SAFE", 1, "SAFE")],
                               "case_id string, ts timestamp, sender string, subject string, verdict string, risk_score int, primary_category string")
    assert [r["case_id"] for r in cs.search_cases(df, query="%_").collect()] == ["c1"]
    assert cs.search_cases(df, domain="X.com").first()["sender"] == "b***@x.com"
    assert cs.search_cases(df, verdict="safe", category="safe").count() == 1


def test_indicators_of_a_graph_are_worked_out_once(spark, monkeypatch):
    from riskframe.plans import case_queries as cq

    count, indicators = spark.sparkContext.accumulator(0), cq.indicators

    def counted(session, sf):
        found = indicators(session, sf)
        return session.createDataFrame(found.rdd.map(lambda r: (count.add(1), r)[1]), found.schema)

    monkeypatch.setattr(cq, "indicators", counted)
    sf = "/root/testdata/sf0.001"
    cases = cq.case_graph(spark, sf).count()
    assert cases == cq.case_verdicts(spark, sf).count() and count.value == indicators(spark, sf).count()
