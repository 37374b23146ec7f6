"""Streaming queries over the events table, run to the end of the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.functions.text import URL_PATTERN
from riskframe.operators.correlation import linkable
from riskframe.plans.datasets import LINK_SQL, MAIL_SQL, SCAN_SQL, mail, table
from riskframe.plans import history_queries as hq
from riskframe.plans import text_queries  # noqa: F401  (registers the batch form first)
from riskframe.plans.registry import QUERIES, query
from riskframe.plans.sqltext import in_list, quoted
from riskframe.streaming import streams as st

_VERDICT = "CASE event_type WHEN 'error' THEN 'DANGER' WHEN 'signup' THEN 'WARNING' ELSE 'SAFE' END"


def _events(spark, sf, watermark="10 minutes"):
    return st.read_events(spark, sf, watermark).withColumnRenamed("event_id", "id")


def _cooldown_sql(interval: str, where: str, same: str = "false") -> str:
    hold = f"({same} = r.last_h AND s.ts - r.last_ts < INTERVAL {interval})" if same != "false" else f"s.ts - r.last_ts < INTERVAL {interval}"
    h = same.replace("s.", "") if same != "false" else "0"
    return f"""
WITH RECURSIVE s AS (SELECT id, user_id, ts, {h} AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS rn FROM ({SCAN_SQL}) WHERE {where}),
r(user_id, rn, id, last_h, last_ts, ok) AS (SELECT user_id, rn, id, h, ts, true FROM s WHERE rn = 1
  UNION ALL SELECT s.user_id, s.rn, s.id, s.h, CASE WHEN {hold.replace(same, 's.h') if same != 'false' else hold} THEN r.last_ts ELSE s.ts END,
    NOT {hold.replace(same, 's.h') if same != 'false' else '(' + hold + ')'} FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1)
SELECT id FROM r WHERE ok"""


@query("stream_alert_cooldown", _cooldown_sql("12 HOUR", "verdict <> 'SAFE'"))
def stream_alert_cooldown(spark, sf):
    alerts = _events(spark, sf).filter(f"{_VERDICT} <> 'SAFE'")
    return st.run_available(st.cooldown(alerts, ["user_id"], 12 * 3600)).select("id")


@query("stream_suppress_repeats", _cooldown_sql("6 HOUR", "true", "s.id % 2"))
def stream_suppress_repeats(spark, sf):
    events = _events(spark, sf).withColumn("content", (F.col("id") % 2).cast("string"))
    return st.run_available(st.suppress_repeats(events, ["user_id"], "content", 6 * 3600)).select("id")


@query("stream_daily_counts", f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, verdict, count(*) AS n FROM ({SCAN_SQL}) GROUP BY 1, 2""")
def stream_daily_counts(spark, sf):
    beat = st.Heartbeat(spark)
    out = st.run_available(st.daily_counts(st.read_events(spark, sf, heartbeat=beat), F.expr(_VERDICT)), heartbeat=beat)
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("stream_debounce", f"""
WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM ({SCAN_SQL})),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, id) AS burst FROM s)
SELECT user_id, max_by(content, ts) AS content, count(*) AS n_events, epoch_us(max(ts) + INTERVAL 1 HOUR) AS burst_end FROM g GROUP BY user_id, burst""")
def stream_debounce(spark, sf):
    beat = st.Heartbeat(spark)
    events = st.read_events(spark, sf, heartbeat=beat).withColumn("content", F.col("props"))
    out = st.run_available(st.debounce(events, ["user_id"], "1 hour"), heartbeat=beat)
    return out.select("user_id", "content", "n_events", F.unix_micros("burst_end").alias("burst_end"))


@query("stream_intent_join", QUERIES["intent_match"].sql)
def stream_intent_join(spark, sf):
    """Files and intents of a user, two days apart at most; the batch form's SQL tells which file uses which intent."""
    beat = st.Heartbeat(spark)
    events = st.prepare(spark).readStream.schema(st.EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf).selectExpr(
        "event_id AS id", "user_id AS tenant", "CAST(ts AS TIMESTAMP) AS ts", "user_id")
    files = events.filter("id % 3 <> 0").selectExpr("tenant", "id AS file_id", "ts", f"{hq._pick(hq._PATHS, 'user_id')} AS path")
    intents = events.filter("id % 3 = 0").selectExpr("tenant", "id AS intent_id", "ts", f"{hq._pick(hq._PKGS, 'id')} AS package", "'DOWNLOAD' AS intent_type")
    rows = beat.with_watermark(st.intent_rows(files, intents))
    return st.run_available(st.match_intents(rows, 48 * 3600), heartbeat=beat).select("file_id", "intent_id")


@query("stream_claims", f"""
WITH RECURSIVE s AS (SELECT id, CAST(user_id AS VARCHAR) AS uri, ts, event_type AS layer, CASE event_type WHEN 'purchase' THEN 'CAPTURED' WHEN 'error' THEN 'PROCESSED' ELSE 'CLAIM' END AS kind,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS rn FROM ({SCAN_SQL})),
r(uri, rn, id, layer, kind, granted, held_at, holder, state) AS (
  SELECT uri, rn, id, layer, kind, true, CASE kind WHEN 'CLAIM' THEN ts END, CASE kind WHEN 'CLAIM' THEN layer END, CASE kind WHEN 'CLAIM' THEN 'P' END FROM s WHERE rn = 1
  UNION ALL SELECT s.uri, s.rn, s.id, s.layer, s.kind, x.state IS NULL,
    CASE s.kind WHEN 'CLAIM' THEN CASE WHEN x.state IS NULL THEN s.ts ELSE x.held_at END WHEN 'CAPTURED' THEN CASE WHEN x.state IS NOT NULL THEN x.held_at END END,
    CASE s.kind WHEN 'CLAIM' THEN CASE WHEN x.state IS NULL THEN s.layer ELSE x.holder END WHEN 'CAPTURED' THEN CASE WHEN x.state IS NOT NULL THEN x.holder END END,
    CASE s.kind WHEN 'CLAIM' THEN coalesce(x.state, 'P') WHEN 'CAPTURED' THEN CASE WHEN x.state IS NOT NULL THEN 'C' END END
  FROM (SELECT r.uri, r.rn, r.held_at, r.holder, CASE WHEN r.state = 'P' AND n.ts - r.held_at > INTERVAL 1 HOUR THEN NULL ELSE r.state END AS state FROM r JOIN s n ON n.uri = r.uri AND n.rn = r.rn + 1) x
  JOIN s ON s.uri = x.uri AND s.rn = x.rn + 1)
SELECT uri, id, layer, granted, holder FROM r WHERE kind = 'CLAIM'""")
def stream_claims(spark, sf):
    kind = F.expr("CASE event_type WHEN 'purchase' THEN 'CAPTURED' WHEN 'error' THEN 'PROCESSED' ELSE 'CLAIM' END")
    events = _events(spark, sf).select(
        F.col("user_id").cast("string").alias("uri"), "ts", "id", kind.alias("kind"), F.col("event_type").alias("layer"))
    return st.run_available(st.claims(events, 3600)).select("uri", "id", "layer", "granted", "holder")


@query("stream_weights")
def stream_weights(spark, sf):
    scores = F.array(*[F.expr(f"CAST((id * {k}) % 101 AS DOUBLE) / 100") for k in (7, 13, 29, 31, 47)])
    fb = _events(spark, sf).select(
        F.col("user_id").alias("tenant"), "ts", "id", F.expr(_VERDICT).alias("verdict"), scores.alias("sub_scores"),
        (F.col("event_type") != "error").alias("is_correct"))
    out = st.run_available(st.adapt_weights(fb), "update")
    last = out.groupBy("tenant").agg(F.max_by(F.struct("weights", "events"), "events").alias("l"))
    return last.select("tenant", "l.events", *[F.round(F.col("l.weights")[i], 9).alias(f"w_{i}") for i in range(5)])


@query("stream_recent_buffer", f"""
WITH r AS (SELECT user_id, id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS rn FROM ({SCAN_SQL}))
SELECT user_id AS tenant, count(*) AS events, round(avg(value), 6) AS mean_score, max(CASE WHEN rn = 1 THEN id END) AS newest_id FROM r WHERE rn <= 20 GROUP BY 1""")
def stream_recent_buffer(spark, sf):
    events = _events(spark, sf).select(F.col("user_id").alias("tenant"), "ts", "id", F.col("value").alias("score"))
    out = st.run_available(st.recent_buffer(events, 20), "update")
    last = out.groupBy("tenant").agg(F.max_by(F.struct("events", "mean_score", "newest_id"), "batch_id").alias("l"))
    return last.select("tenant", "l.events", F.round("l.mean_score", 6).alias("mean_score"), "l.newest_id")


@query("stream_cached_lookup", f"""
SELECT id, CASE WHEN epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 00:00:00') BETWEEN 0 AND 86400000000 THEN c_mktsegment END AS segment
FROM ({SCAN_SQL}) LEFT JOIN customer ON c_custkey = user_id""")
def stream_cached_lookup(spark, sf):
    dim = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"),
        F.to_timestamp(F.lit("2024-01-10 00:00:00")).alias("fetched_at"))
    return st.run_available(st.cached_lookup(_events(spark, sf), dim, "user_id", ttl_seconds=86400)).select("id", "segment")


@query("stream_overlay_alerts", f"""
WITH RECURSIVE s AS (SELECT id, user_id AS device_id, package, ts, row_number() OVER (PARTITION BY user_id, package ORDER BY ts, id) AS rn FROM (
  SELECT *, split_part('com.sbi.lotusintouch|com.example.game|net.one97.paytm|com.axis.mobile', '|', CAST(id % 4 AS INT) + 1) AS package FROM ({SCAN_SQL}))
  WHERE (contains(package, 'sbi') OR contains(package, 'paytm')) AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00' AND user_id IN (SELECT c_custkey FROM customer)),
r(device_id, package, rn, id, last_ts, ok) AS (SELECT device_id, package, rn, id, ts, true FROM s WHERE rn = 1
  UNION ALL SELECT s.device_id, s.package, s.rn, s.id, CASE WHEN s.ts - r.last_ts >= INTERVAL 24 HOUR THEN s.ts ELSE r.last_ts END, s.ts - r.last_ts >= INTERVAL 24 HOUR
  FROM r JOIN s ON s.device_id = r.device_id AND s.package = r.package AND s.rn = r.rn + 1)
SELECT device_id, package, id FROM r WHERE ok""")
def stream_overlay_alerts(spark, sf):
    packages = "split_part('com.sbi.lotusintouch|com.example.game|net.one97.paytm|com.axis.mobile', '|', CAST(id % 4 AS INT) + 1)"
    fg = _events(spark, sf).selectExpr("user_id AS device_id", f"{packages} AS package", "'' AS label", "ts", "id")
    overlays = table(spark, sf, "customer").selectExpr(
        "c_custkey AS device_id", "concat('overlay', CAST(c_nationkey AS STRING)) AS overlay_package",
        "TIMESTAMP'2024-01-05 00:00:00' AS active_from", "TIMESTAMP'2024-01-25 00:00:00' AS active_to")
    return st.run_available(st.overlay_alerts(fg, overlays, 86400)).select("device_id", "package", "id")


@query("stream_dedup_exact", f"""
WITH RECURSIVE s AS (SELECT id, user_id, content AS props, ts, row_number() OVER (PARTITION BY user_id, content ORDER BY ts, id) AS rn FROM ({SCAN_SQL})),
r(user_id, props, rn, id, last_ts, ok) AS (SELECT user_id, props, rn, id, ts, true FROM s WHERE rn = 1
  UNION ALL SELECT s.user_id, s.props, s.rn, s.id, CASE WHEN s.ts - r.last_ts < INTERVAL 12 HOUR THEN r.last_ts ELSE s.ts END,
    s.ts - r.last_ts >= INTERVAL 12 HOUR FROM r JOIN s ON s.user_id = r.user_id AND s.props = r.props AND s.rn = r.rn + 1)
SELECT id FROM r WHERE ok""")
def stream_dedup_exact(spark, sf):
    return st.run_available(st.dedup_exact(_events(spark, sf), ["user_id", "props"], 12 * 3600)).select("id")


def _batch_indicators() -> str:
    """Indicators of a message and its micro-batch (three by id), by the SQL of the batch forms."""
    from riskframe.plans.url_queries import _HOSTS_CTE

    origin = QUERIES["origin_ip"].sql
    urls = (f"SELECT email_id AS link_id, unnest(list_distinct(list_transform(regexp_extract_all(body_text, {quoted(URL_PATTERN)}), "
            f"lambda x: rtrim(x, '.')))) AS url FROM ({MAIL_SQL})")
    hosts = _HOSTS_CTE.replace(LINK_SQL, urls)
    return f"""
k AS (SELECT email_id, sender, trim(rtrim(CASE WHEN contains(sender, '@') THEN string_split(sender, '@')[-1] ELSE sender END, '>')) AS domain FROM ({MAIL_SQL})),
r AS (SELECT email_id, 'sender_email' AS t, sender AS v, lower(trim(sender)) AS n FROM k
  UNION ALL SELECT email_id, 'sender_domain', domain, lower(domain) FROM k WHERE contains(sender, '@')
  UNION ALL SELECT email_id, 'origin_ip', origin_ip, origin_ip FROM ({origin}) WHERE origin_ip <> 'ORIGIN_NOT_DETERMINABLE'
  UNION ALL SELECT DISTINCT link_id, 'url_domain', host, host FROM (WITH {hosts} SELECT link_id, host FROM s) WHERE coalesce(host, '') <> ''
  UNION ALL SELECT doc_id, 'attachment_hash', sha256(text), sha256(text) FROM documents),
u AS (SELECT DISTINCT CAST(email_id AS VARCHAR) AS case_id, email_id % 3 AS batch, t, v, n FROM r WHERE coalesce(v, '') <> '' AND n <> '' AND NOT {in_list('n', lx.UBIQUITOUS_VALUES)})"""


@query("stream_triage", f"""
WITH {_batch_indicators()}, m AS (SELECT DISTINCT n, case_id, batch FROM u),
seen AS (SELECT b.n, b.batch, (SELECT count(*) FROM m WHERE m.n = b.n AND m.batch <= b.batch) AS cases FROM (SELECT DISTINCT n, batch FROM m) b),
c AS (SELECT case_id, count(*) AS n_indicators, sum(cases - 1) AS shared, sum(least(cases - 1, 10)) AS n_links FROM u JOIN seen USING (n, batch) GROUP BY 1),
h AS (SELECT u.case_id, min(m.case_id) AS first_case FROM u JOIN m ON u.n = m.n AND m.batch <= u.batch AND m.case_id <> u.case_id GROUP BY 1)
SELECT t.email_id, verdict, risk_score, primary_category, coalesce(n_indicators, 0) AS n_indicators, CAST(coalesce(shared, 0) AS BIGINT) AS shared_cases,
  CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, first_case
FROM ({QUERIES['email_triage'].sql}) t LEFT JOIN c ON c.case_id = CAST(t.email_id AS VARCHAR) LEFT JOIN h ON h.case_id = CAST(t.email_id AS VARCHAR)""")
def stream_triage(spark, sf):
    """Messages in three micro-batches: verdicts, indicators, and links to what came before."""
    staged = st.shared_folder(st.prepare(spark))
    messages = mail(spark, sf, "array(sha2(text, 256)) AS attachment_hashes").select(
        "email_id", "sender", "reply_to", "return_path", "subject", "body_text", "authentication_results", "raw_headers", "received_headers", "attachment_hashes")
    out = f"{staged}/out"
    for part in range(3):
        messages.filter(F.col("email_id") % 3 == part).write.mode("append").parquet(f"{staged}/in")
        stream = spark.readStream.schema(messages.schema).parquet(f"{staged}/in")
        st.triage_batches(stream, out, f"{staged}/checkpoint").awaitTermination()
    key = F.col("case_id").cast("long").alias("email_id")
    usable = linkable(spark.read.parquet(f"{out}/indicators")).select("case_id", "indicator_type", "indicator_value", "normalized_value").distinct()
    links = spark.read.parquet(f"{out}/links")
    counted = usable.groupBy(key).agg(F.count(F.lit(1)).alias("n_indicators"))
    shared = links.groupBy(key, "indicator_type", "indicator_value", "normalized_value").agg(
        F.max("value_case_count").alias("n"), F.count(F.lit(1)).alias("k"), F.min("target_case_id").alias("first_case"))
    shared = shared.groupBy("email_id").agg(
        F.sum(F.col("n") - 1).alias("shared_cases"), F.sum("k").alias("n_links"), F.min("first_case").alias("first_case"))
    verdicts = spark.read.parquet(f"{out}/verdicts").select("email_id", "verdict", "risk_score", "primary_category")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return verdicts.join(counted, "email_id", "left").join(shared, "email_id", "left").select(
        "email_id", "verdict", "risk_score", "primary_category", zero("n_indicators"), zero("shared_cases"), zero("n_links"), "first_case")
