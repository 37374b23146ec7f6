"""The driver contract, and a sample of queries against their reference SQL."""

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "message_risk_rollup", "redact_pii", "forwarding", "phrase_hits", "url_risk", "mobile_domain_spoof", "sender_spoofing", "relay_hops",
    "origin_ip", "cross_case_correlation", "campaigns", "verdict_rollup", "reputation_as_of", "suppress_repeats", "binary_metrics",
    "ooxml_features", "malware_risk", "risk_bands",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_reference_query_has_a_query():
    q, o = contract.queries(), contract.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100 and len(o) > 90


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_reference_sql(spark, db, name):
    def norm(v):
        return round(v, 6) if isinstance(v, float) else v

    df = contract.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = db.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_queries_stay_without_the_training_data_modules(monkeypatch):
    import importlib

    def missing(name, *rest):
        raise ModuleNotFoundError(name)

    monkeypatch.setattr(importlib, "import_module", missing)
    assert len(contract.queries()) > 100 and not any(n.startswith("op") for n in contract.queries() if n[2:3].isdigit())
