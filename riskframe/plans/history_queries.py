"""Queries over scan history, downloads, feedback and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.functions import fusion
from riskframe.operators import evaluation as ev
from riskframe.operators import history as hs
from riskframe.plans.datasets import PREDICTION_SQL, SCAN_SQL, predictions, scans, table
from riskframe.plans.registry import query
from riskframe.sources.writers import export_frame

_AS_OF = "2024-01-20 10:00:00"


def _as_of():
    return F.to_timestamp(F.lit(_AS_OF))


@query("dashboard", f"""
SELECT count_if(ts >= DATE '2024-01-20') AS total_today, count_if(ts >= DATE '2024-01-20' AND verdict = 'DANGER') AS dangers_today,
  count_if(ts >= DATE '2024-01-20' AND verdict = 'SAFE') AS safe_today, count_if(ts >= DATE '2024-01-20' AND verdict = 'WARNING') AS warnings_today,
  count(*) AS total_overall, count_if(verdict = 'SAFE') AS safe_overall FROM ({SCAN_SQL})""")
def dashboard(spark, sf):
    return hs.dashboard(scans(spark, sf), _as_of())


@query("verdict_rollup", f"""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, verdict, count(*) AS n, GROUPING(CAST(ts AS DATE), verdict) AS grouping_level FROM ({SCAN_SQL})
GROUP BY GROUPING SETS ((CAST(ts AS DATE), verdict), (CAST(ts AS DATE)), (verdict), ())""")
def verdict_rollup(spark, sf):
    return hs.verdict_rollup(scans(spark, sf)).withColumn("day", F.col("day").cast("string"))


_W = "CASE verdict WHEN 'DANGER' THEN 1.0 WHEN 'WARNING' THEN 0.5 ELSE 0.0 END"


@query("sender_reputation", f"SELECT sender, round(avg(CAST({_W} AS DOUBLE)), 9) AS reputation, count(*) AS n_scans FROM ({SCAN_SQL}) GROUP BY 1")
def sender_reputation(spark, sf):
    return hs.sender_reputation(scans(spark, sf)).withColumn("reputation", F.round("reputation", 9))


@query("reputation_as_of", f"""
SELECT id, round(coalesce(avg(CAST({_W} AS DOUBLE)) OVER (PARTITION BY sender ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS reputation FROM ({SCAN_SQL})""")
def reputation_as_of(spark, sf):
    return hs.reputation_asof(scans(spark, sf)).select("id", F.round("reputation", 9).alias("reputation"))


@query("suppress_repeats", f"""
WITH RECURSIVE s AS (SELECT id, user_id, ts, CAST(id % 2 AS INT) AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS rn FROM ({SCAN_SQL})),
r(user_id, rn, id, h, last_h, last_ts, ok) AS (
  SELECT user_id, rn, id, h, h, ts, true FROM s WHERE rn = 1
  UNION ALL SELECT s.user_id, s.rn, s.id, s.h, s.h, CASE WHEN s.h = r.last_h AND s.ts - r.last_ts < INTERVAL 6 HOUR THEN r.last_ts ELSE s.ts END,
    NOT (s.h = r.last_h AND s.ts - r.last_ts < INTERVAL 6 HOUR) FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1)
SELECT id FROM r WHERE ok""")
def suppress_repeats(spark, sf):
    df = scans(spark, sf).withColumn("h", (F.col("id") % 2).cast("int"))
    return hs.suppress_repeats(df, "user_id", "h", seconds=6 * 3600).select("id")


@query("alert_cooldown", f"""
WITH RECURSIVE s AS (SELECT id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS rn FROM ({SCAN_SQL}) WHERE verdict <> 'SAFE'),
r(user_id, rn, id, last_ts, ok) AS (SELECT user_id, rn, id, ts, true FROM s WHERE rn = 1
  UNION ALL SELECT s.user_id, s.rn, s.id, CASE WHEN s.ts - r.last_ts >= INTERVAL 12 HOUR THEN s.ts ELSE r.last_ts END, s.ts - r.last_ts >= INTERVAL 12 HOUR
  FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1)
SELECT id FROM r WHERE ok""")
def alert_cooldown(spark, sf):
    from riskframe.operators.ordered import spaced_out
    return spaced_out(hs.alertable(scans(spark, sf)), ["user_id"], "ts", "id", 12 * 3600).select("id")


@query("stable_files", f"""
WITH p AS (SELECT user_id, ts, CAST(floor(value / 20) AS INT) AS size, lag(CAST(floor(value / 20) AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM ({SCAN_SQL}))
SELECT user_id AS uri, epoch_us(min(ts)) AS ready_at, min_by(size, ts) AS size FROM p WHERE size > 0 AND size = prev GROUP BY 1""")
def stable_files(spark, sf):
    polls = scans(spark, sf).select(F.col("user_id").alias("uri"), "ts", F.floor(F.col("value") / 20).cast("int").alias("size"))
    return hs.stable_files(polls).withColumn("ready_at", F.unix_micros("ready_at"))


@query("recent_scans", f"SELECT id, sender, verdict FROM ({SCAN_SQL}) ORDER BY ts DESC, id DESC LIMIT 5")
def recent_scans(spark, sf):
    return hs.most_recent(scans(spark, sf)).select("id", "sender", "verdict")


@query("scans_by_verdict", f"SELECT id, sender, verdict FROM ({SCAN_SQL}) WHERE verdict = 'WARNING'")
def scans_by_verdict(spark, sf):
    return hs.by_verdict(scans(spark, sf), "WARNING").select("id", "sender", "verdict")


@query("scans_of_sender", f"SELECT id, sender, verdict FROM ({SCAN_SQL}) WHERE sender = 'user7'")
def scans_of_sender(spark, sf):
    return hs.get_by_sender(scans(spark, sf), "user7").select("id", "sender", "verdict")


@query("history_filter", f"""
SELECT id FROM ({SCAN_SQL}) WHERE verdict = 'SAFE' AND (contains(lower(sender), 'user1') OR contains(lower(snippet), 'user1') OR contains(lower(subject), 'user1'))""")
def history_filter(spark, sf):
    return hs.filter_history(scans(spark, sf), "SAFE", " USER1 ").select("id")


@query("batch_summary", f"""
SELECT count(*) AS scanned, count_if(verdict IN ('DANGER', 'WARNING')) AS threats, count_if(verdict = 'DANGER') AS dangers, count_if(verdict = 'WARNING') AS warnings
FROM (SELECT verdict FROM ({SCAN_SQL}) ORDER BY ts DESC, id DESC LIMIT 50)""")
def batch_summary(spark, sf):
    return hs.batch_summary(scans(spark, sf))


@query("expired_count", f"SELECT count_if(ts < TIMESTAMP '2024-01-10') AS expired FROM ({SCAN_SQL})")
def expired_count(spark, sf):
    return hs.count_expired(scans(spark, sf), F.to_timestamp(F.lit("2024-01-10 00:00:00")))


@query("latency", f"SELECT verdict, round(avg(value), 6) AS avg_latency, quantile_disc(value, 0.95) AS p95_latency, count(*) AS n FROM ({SCAN_SQL}) GROUP BY 1")
def latency(spark, sf):
    return hs.latency_stats(scans(spark, sf), ["verdict"], "value").withColumn("avg_latency", F.round("avg_latency", 6))


@query("feedback_update", f"""
SELECT id, id % 7 = 0 AS reviewed, CASE WHEN id % 7 = 0 THEN 'wrong' END AS feedback, CASE WHEN event_type LIKE 's%' THEN '' ELSE event_type END AS category FROM ({SCAN_SQL})""")
def feedback_update(spark, sf):
    df = scans(spark, sf).withColumns({"reviewed": F.lit(False), "feedback": F.lit(None).cast("string"), "category": F.col("event_type")})
    given = df.filter("id % 7 = 0").select("id", F.lit("wrong").alias("feedback"))
    return hs.scrub_category(hs.apply_feedback(df, given), ["s%"]).select("id", "reviewed", "feedback", "category")


@query("alerts", f"""
SELECT id FROM ({SCAN_SQL}) WHERE verdict = 'DANGER' OR (verdict = 'WARNING' AND user_id % 3 <> 0)""")
def alerts(spark, sf):
    df = scans(spark, sf)
    prefs = df.select("user_id").distinct().select("user_id", F.lit(True).alias("alert_danger"), (F.col("user_id") % 3 != 0).alias("alert_warning"))
    return hs.rows_to_log(hs.alertable(df, prefs), log_all=False).select("id")


@query("scan_export", f"""
SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", verdict, concat('f', id % 3, '; ', event_type) AS red_flags FROM ({SCAN_SQL})""")
def scan_export(spark, sf):
    df = scans(spark, sf).withColumn("flags", F.array(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")), F.col("event_type")))
    return export_frame(df).select("id", "timestamp", "verdict", "red_flags")


# -- disagreement ----------------------------------------------------------

_COMPS = ["url", "nlp", "structural", "typosquat"]
_LONG = " UNION ALL ".join(f"SELECT sample_id, verdict, ml_score, {c} AS score FROM p" for c in _COMPS)
_DIS = f"""p AS ({PREDICTION_SQL}), l AS ({_LONG}),
d AS (SELECT sample_id, verdict, ml_score, CASE WHEN count_if(score > 0) >= 2 THEN stddev_pop(CASE WHEN score > 0 THEN score END) ELSE 0 END AS disagreement,
  count_if(score > 0) AS active_models FROM l GROUP BY 1, 2, 3)"""


def _disagreements(spark, sf):
    p = predictions(spark, sf)
    long = p.unpivot(["sample_id"], _COMPS, "component", "score")
    return p.join(hs.score_disagreement(long, "sample_id"), "sample_id")


@query("score_disagreement", f"WITH {_DIS} SELECT sample_id, round(disagreement, 9) AS disagreement, active_models FROM d")
def score_disagreement(spark, sf):
    return _disagreements(spark, sf).select("sample_id", F.round("disagreement", 9).alias("disagreement"), "active_models")


@query("disagreement_summary", f"""
WITH {_DIS}, f AS (SELECT * FROM d WHERE disagreement >= 0.25)
SELECT count(*) AS events, round(avg(disagreement), 9) AS mean_disagreement, round(avg(ml_score), 9) AS mean_ml_score,
  (SELECT string_agg(concat(verdict, '=', n), ',' ORDER BY verdict) FROM (SELECT verdict, count(*) AS n FROM f GROUP BY 1)) AS verdict_counts FROM f""")
def disagreement_summary(spark, sf):
    out = hs.disagreement_summary(_disagreements(spark, sf))
    pairs = F.transform(F.array_sort(F.map_entries("verdict_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("events", F.round("mean_disagreement", 9).alias("mean_disagreement"),
                      F.round("mean_ml_score", 9).alias("mean_ml_score"), F.array_join(pairs, ",").alias("verdict_counts"))


@query("recent_disagreements", f"""
WITH {_DIS}, r AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY sample_id DESC) AS rank FROM d WHERE disagreement >= 0.25)
SELECT sample_id, verdict, rank FROM r WHERE rank <= 20""")
def recent_disagreements(spark, sf):
    return hs.recent_disagreements(_disagreements(spark, sf), ["verdict"], 20, "sample_id", "sample_id").select("sample_id", "verdict", "rank")


@query("vote_mean", f"""
SELECT message_id, round(max(v), 9) AS max_vote, max(v) > 0.80 AS anomaly FROM (
  SELECT l_orderkey AS message_id, l_partkey AS url, avg(CASE WHEN l_linenumber = 5 THEN 0.5 ELSE l_discount * 10 END) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def vote_mean(spark, sf):
    s = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("message_id"), F.col("l_partkey").alias("url"),
        F.when(F.col("l_linenumber") != 5, F.col("l_discount") * 10).alias("score"))
    return hs.vote_mean(s, "message_id", "url").withColumn("max_vote", F.round("max_vote", 9))


# -- evaluation ------------------------------------------------------------

_T, _A = "expected IN ('SUSPICIOUS','PHISHING','MALICIOUS')", "verdict IN ('WARNING','DANGER')"


def _rates(prefix: str = "") -> str:
    div = lambda a, b: f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"
    p, r = div("tp", "tp + fp"), div("tp", "tp + fn")
    vals = {"accuracy": div("tp + tn", "tp + fp + tn + fn"), "precision": p, "recall": r, "specificity": div("tn", "tn + fp"),
            "false_positive_rate": div("fp", "fp + tn"), "false_negative_rate": div("fn", "fn + tp"),
            "f1": f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0)"}
    return ", ".join(f"round({e}, 9) AS {n}" for n, e in vals.items())


_RATE_COLS = ["accuracy", "precision", "recall", "specificity", "false_positive_rate", "false_negative_rate", "f1"]


def _rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in _RATE_COLS if c in df.columns})


@query("binary_metrics", f"""
SELECT category, tp, fp, tn, fn, {_rates()} FROM (SELECT category, count_if({_T} AND {_A}) AS tp, count_if(NOT ({_T}) AND {_A}) AS fp,
  count_if(NOT ({_T}) AND NOT ({_A})) AS tn, count_if({_T} AND NOT ({_A})) AS fn FROM ({PREDICTION_SQL}) GROUP BY 1)""")
def binary_metrics(spark, sf):
    return _rounded(ev.binary_metrics(predictions(spark, sf), ["category"]))


_CLASS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS class, count_if(expected = '{c}') AS support, count_if(expected = '{c}' AND {h}) AS tp, count_if(expected <> '{c}' AND {h}) AS fp FROM p"
    for c, h in (("SAFE", "verdict = 'SAFE'"), ("SUSPICIOUS", "verdict = 'WARNING'"), ("PHISHING", "verdict IN ('WARNING','DANGER')"), ("MALICIOUS", "verdict = 'DANGER'")))


@query("class_metrics", f"""
WITH p AS ({PREDICTION_SQL}), c AS ({_CLASS_SQL}), r AS (SELECT class, support, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS pr, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS re FROM c WHERE support > 0)
SELECT class, round(pr, 9) AS precision, round(re, 9) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 9) AS f1, support FROM r""")
def class_metrics(spark, sf):
    return _rounded(ev.class_metrics(predictions(spark, sf)))


_THR = [0.25, 0.5, 0.75]
_SWEEP = " UNION ALL ".join(
    f"SELECT '{c}' AS component, {t}::DOUBLE AS threshold, count_if({_T} AND {c} > {t}) AS tp, count_if(NOT ({_T}) AND {c} > {t}) AS fp, "
    f"count_if(NOT ({_T}) AND NOT {c} > {t}) AS tn, count_if({_T} AND NOT {c} > {t}) AS fn FROM p" for c in _COMPS for t in _THR)


@query("component_metrics", f"WITH p AS ({PREDICTION_SQL}), s AS ({_SWEEP}) SELECT component, threshold, tp, fp, tn, fn, {_rates()} FROM s")
def component_metrics(spark, sf):
    return _rounded(ev.component_metrics(predictions(spark, sf), _COMPS, _THR))


@query("error_rows", f"""
SELECT sample_id, CASE WHEN {_T} AND {_A} THEN 'TP' WHEN {_T} THEN 'FN' WHEN {_A} THEN 'FP' ELSE 'TN' END AS outcome FROM ({PREDICTION_SQL})""")
def error_rows(spark, sf):
    return ev.error_rows(predictions(spark, sf)).select("sample_id", "outcome")


@query("suite_pass", f"""
SELECT category, count(*) AS total, count_if(ok) AS passed, round(avg(ok::INT), 9) AS pass_rate FROM (SELECT category,
  CASE category WHEN 'LEGIT' THEN verdict = 'SAFE' WHEN 'SCAM' THEN verdict <> 'SAFE' ELSE true END AS ok FROM ({PREDICTION_SQL})) GROUP BY 1""")
def suite_pass(spark, sf):
    return ev.suite_pass(predictions(spark, sf)).withColumn("pass_rate", F.round("pass_rate", 9))


@query("roc_auc", f"""
WITH p AS ({PREDICTION_SQL}), a AS (SELECT ml_score AS s FROM p WHERE label = 1), b AS (SELECT ml_score AS s FROM p WHERE label <> 1)
SELECT (SELECT count(*) FROM a) AS positives, (SELECT count(*) FROM b) AS negatives,
  round((SELECT sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) FROM a, b)::DOUBLE / ((SELECT count(*) FROM a) * (SELECT count(*) FROM b)), 9) AS auc""")
def roc_auc(spark, sf):
    return ev.exact_auc(predictions(spark, sf), "ml_score", "label").withColumn("auc", F.round("auc", 9))


@query("multiclass_report", f"""
WITH p AS (SELECT expected AS a, CASE verdict WHEN 'DANGER' THEN 'MALICIOUS' WHEN 'WARNING' THEN 'SUSPICIOUS' ELSE 'SAFE' END AS b FROM ({PREDICTION_SQL})),
k AS (SELECT a AS class FROM p UNION SELECT b FROM p),
s AS (SELECT class, (SELECT count(*) FROM p WHERE a = class) AS support, (SELECT count(*) FROM p WHERE b = class) AS pred, (SELECT count(*) FROM p WHERE a = class AND b = class) AS tp FROM k),
r AS (SELECT class, support, coalesce(tp::DOUBLE / nullif(pred, 0), 0) AS pr, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS re FROM s)
SELECT class, round(pr, 9) AS precision, round(re, 9) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 9) AS f1, support FROM r""")
def multiclass_report(spark, sf):
    p = predictions(spark, sf).select(F.col("expected").alias("label"), fusion.verdict_bands(F.col("verdict")).alias("prediction"))
    return _rounded(ev.multiclass_report(p))


# -- downloads and intents -------------------------------------------------

_PATHS = ["/sdcard/Download/", "/sdcard/Android/media/com.whatsapp/WhatsApp/Media/WhatsApp Documents/", "/sdcard/DCIM/",
          "/Android/media/com.whatsapp.w4b/WhatsApp Business/Media/WhatsApp Business Documents/"]
_NAMES = ["a.pdf", "b.apk", "c.tmp", "noext", "d.zip"]
_PKGS = ["com.whatsapp", "com.google.android.gm", "com.android.chrome", "com.whatsapp.w4b", "com.android.providers.downloads"]


def _pick(values, index):
    return f"split_part('{'|'.join(values)}', '|', CAST(({index}) % {len(values)} AS INT) + 1)"


_FILES = f"SELECT id AS file_id, user_id, ts, {_pick(_PATHS, 'user_id')} AS path, {_pick(_NAMES, 'id')} AS name, CAST(floor(value) AS INT) AS size, id FROM ({SCAN_SQL}) WHERE id % 3 <> 0"
_INTENTS = f"SELECT id AS intent_id, user_id, ts, {_pick(_PKGS, 'id')} AS package, 'DOWNLOAD' AS intent_type FROM ({SCAN_SQL}) WHERE id % 3 = 0"


def _files(spark, sf):
    return scans(spark, sf).filter("id % 3 <> 0").selectExpr(
        "id AS file_id", "user_id", "ts", f"{_pick(_PATHS, 'user_id')} AS path", f"{_pick(_NAMES, 'id')} AS name", "CAST(floor(value) AS INT) AS size")


def _intents(spark, sf):
    return scans(spark, sf).filter("id % 3 = 0").selectExpr(
        "id AS intent_id", "user_id", "ts", f"{_pick(_PKGS, 'id')} AS package", "'DOWNLOAD' AS intent_type")


@query("qualifying_downloads", f"""
SELECT file_id FROM ({_FILES}) WHERE size > 0 AND contains(name, '.') AND string_split(name, '.')[-1] NOT IN ('tmp','crdownload','part','download','nomedia','cache')
  AND (contains(lower(path), 'download') OR contains(lower(path), 'whatsapp documents') OR contains(lower(path), 'whatsapp business documents'))""")
def qualifying_downloads(spark, sf):
    return hs.qualifying_downloads(_files(spark, sf)).select("file_id")


@query("missed_files", f"""
SELECT file_id FROM ({_FILES}) f WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 10 DAY AND file_id % 4 <> 1""")
def missed_files(spark, sf):
    files = _files(spark, sf).withColumn("uri", F.col("file_id"))
    claims = files.filter("file_id % 4 = 1").select("uri")
    return hs.missed_files(files, claims, F.to_timestamp(F.lit("2024-01-30 12:00:00")), 10 * 86400).select("file_id")


_ASOF = f"""
f AS ({_FILES}), i AS ({_INTENTS}),
c AS (SELECT *, CASE WHEN contains(lower(path), 'com.whatsapp.w4b') THEN 'com.whatsapp.w4b' WHEN contains(lower(path), 'whatsapp') THEN 'com.whatsapp'
  WHEN contains(lower(path), 'download') THEN 'D' END AS kind FROM f)"""


def _level(pkg_case: str, source: str, name: str) -> str:
    return f"""
{name}_l AS (SELECT a.file_id, a.ts AS fts, arg_max(i.intent_id, (i.ts, i.intent_id)) AS intent_id, max(i.ts) AS its FROM (SELECT *, {pkg_case} AS package FROM {source}) a
  JOIN i ON i.user_id = a.user_id AND i.package = a.package AND i.ts <= a.ts GROUP BY 1, 2),
{name} AS (SELECT intent_id, arg_min(file_id, (fts, file_id)) AS file_id FROM {name}_l WHERE fts - its <= INTERVAL 48 HOUR GROUP BY 1)"""


@query("intent_match", f"""
WITH {_ASOF},
{_level("CASE kind WHEN 'D' THEN 'com.google.android.gm' ELSE kind END", "c", "w1")},
c2 AS (SELECT * FROM c WHERE kind = 'D' AND file_id NOT IN (SELECT file_id FROM w1)), {_level("'com.android.chrome'", "c2", "w2")},
c3 AS (SELECT * FROM c2 WHERE file_id NOT IN (SELECT file_id FROM w2)), {_level("'com.android.providers.downloads'", "c3", "w3")},
w AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3)
SELECT f.file_id, w.intent_id FROM f LEFT JOIN w ON f.file_id = w.file_id""")
def intent_match(spark, sf):
    return hs.match_intents(_files(spark, sf), _intents(spark, sf), seconds=48 * 3600, tenant=["user_id"]).select("file_id", "intent_id")


@query("latest_intent", f"""
WITH f AS ({_FILES}), i AS ({_INTENTS}), l AS (SELECT f.file_id, f.ts AS fts, i.intent_id, i.ts AS its FROM f ASOF LEFT JOIN i ON f.user_id = i.user_id AND f.ts >= i.ts)
SELECT file_id, CASE WHEN fts - its <= INTERVAL 12 HOUR THEN intent_id END AS intent_id FROM l""")
def latest_intent(spark, sf):
    return hs.latest_intent(_files(spark, sf), _intents(spark, sf), seconds=12 * 3600, tenant=["user_id"]).select("file_id", "intent_id")


@query("latest_claim", f"""
SELECT user_id, max_by(id, (ts, id)) AS uri FROM ({SCAN_SQL}) WHERE (event_type <> 'view' OR ts >= TIMESTAMP '{_AS_OF}' - INTERVAL 10 SECOND) AND event_type <> 'click' GROUP BY 1""")
def latest_claim(spark, sf):
    state = F.when(F.col("event_type") == "view", "PENDING_CAPTURE").when(F.col("event_type") == "click", "PROCESSED").otherwise("CAPTURED")
    claims = scans(spark, sf).select("user_id", F.col("id").alias("uri"), "ts", state.alias("state"))
    return hs.latest_claim(claims, ["user_id"], _as_of()).select("user_id", "uri")


# -- weights ---------------------------------------------------------------

@query("adaptive_weights")
def adaptive_weights(spark, sf):
    scores = F.array(*[F.expr(f"CAST((id * {k}) % 101 AS DOUBLE) / 100") for k in (7, 13, 29, 31, 47)])
    fb = scans(spark, sf).select(
        F.col("user_id").alias("tenant"), "ts", "id", "verdict", scores.alias("sub_scores"), (F.col("event_type") != "error").alias("is_correct"))
    out = hs.adapt_weights(fb)
    return out.select("tenant", "events", *[F.round(F.col("weights")[i], 9).alias(f"w_{c}") for i, c in enumerate(lx.COMPONENTS)])


@query("verdict_mapping", f"""
SELECT id, CASE verdict WHEN 'DANGER' THEN 'MALICIOUS' WHEN 'WARNING' THEN 'SUSPICIOUS' ELSE 'SAFE' END AS band,
  CASE verdict WHEN 'DANGER' THEN 85 WHEN 'WARNING' THEN 55 ELSE 10 END AS score,
  CASE WHEN risk_score >= 45 THEN 'SUSPICIOUS' WHEN risk_score >= 20 THEN 'UNVERIFIED' ELSE 'SAFE' END AS direct,
  CASE WHEN risk_score >= 70 THEN 'DANGER' WHEN risk_score >= 40 THEN 'WARNING' ELSE 'SAFE' END AS three_band FROM ({SCAN_SQL})""")
def verdict_mapping(spark, sf):
    v, s = F.col("verdict"), F.col("risk_score")
    return scans(spark, sf).select("id", fusion.verdict_bands(v).alias("band"), fusion.representative_score(v).alias("score"),
                                   fusion.direct_verdict(s).alias("direct"), fusion.three_band(s).alias("three_band"))
