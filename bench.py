"""Headline queries, timed. Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the list below).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskframe.plans.registry import load_all  # noqa: E402
from riskframe.session import local_session  # noqa: E402

HEADLINE = [
    "message_risk_rollup", "email_triage", "text_signals", "redact_pii", "credential_exposure", "forwarding",
    "romanised_language", "url_risk", "url_lexical_features", "brand_imitation", "link_text_mismatch", "auth_results",
    "relay_hops", "relay_anomaly", "cross_case_correlation", "attribution", "campaigns", "case_search", "case_upsert",
    "dashboard", "verdict_rollup", "sender_reputation", "reputation_as_of", "suppress_repeats", "intent_match",
    "vote_mean", "component_metrics", "roc_auc", "ooxml_features", "pdf_scan", "malware_risk", "stream_alert_cooldown",
    "stream_daily_counts",
]
#: Input rows of the throughput figures.
ROWS = {"email_triage": "documents", "url_risk": "pages", "verdict_rollup": "events", "stream_alert_cooldown": "events",
        "message_risk_rollup": "documents"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "riskframe-bench")
    registry = load_all()
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        start = time.perf_counter()
        try:
            registry[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # one failing query must not hide the others
            failed[name] = str(error)[:200]
    rates = {}
    for name, source in ROWS.items():
        if name in seconds:
            rates[name] = round(spark.read.parquet(f"{sf_dir}/{source}.parquet").count() / seconds[name], 1)
    scale = re.search(r"sf([0-9.]+)$", sf_dir.rstrip("/"))
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "rows_per_sec": rates, "failed": failed, "sf": float(scale.group(1)) if scale else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
