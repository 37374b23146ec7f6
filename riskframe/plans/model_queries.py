"""Queries over model scores, fusion rules, training and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.functions import fusion
from riskframe.functions import text as tx
from riskframe.functions.sql import register_functions
from riskframe.functions.urls import is_trusted_mobile, lexical_features
from riskframe.functions.common import host_of
from riskframe.operators import ml
from riskframe.operators.enrichment import spoofed_links
from riskframe.operators.signals import SignalRegistry, active_scores, local_scores, weighted_vote
from riskframe.plans.datasets import MAIL_SQL, PREDICTION_SQL, SCAN_SQL, links, mail, predictions, scans, table
from riskframe.plans.registry import query
from riskframe.plans.sqltext import has_any, hit_count, in_list, quoted
from riskframe.sources.tables import build_metadata, labelled, load_dims


# -- model scores ----------------------------------------------------------

_MODELS = ["url_cnn_v1", "text_nlp_v1", "bodmas_v1", "bec_classifier", "email_fraud_nlp"]
_ACTIVE = ", ".join(f"('{m}', {w})" for m, s, w in lx.MODEL_MANIFEST if s == "active")


@query("active_model_scores", f"""
WITH p AS (SELECT vec_id, unnest(['{"','".join(_MODELS)}']) AS model_id, unnest([0, 1, 2, 3, 4]) AS i FROM embeddings),
a(model_id, weight) AS (VALUES {_ACTIVE}), s AS (SELECT vec_id, p.model_id, CASE WHEN (vec_id + i) % 7 = 0 THEN NULL ELSE ((vec_id * 7 + i * 31) % 101) / 100.0 END AS r, weight FROM p JOIN a ON p.model_id = a.model_id)
SELECT vec_id, round(coalesce(sum(CASE WHEN r IS NOT NULL THEN r * weight END) / sum(CASE WHEN r IS NOT NULL THEN weight END), 0), 6) AS vote,
  count_if(r IS NOT NULL) AS models_ready, count_if(r IS NULL) AS models_failed FROM s GROUP BY 1""")
def active_model_scores(spark, sf):
    registry = SignalRegistry()

    def model(i):
        return lambda df: F.when((F.col("vec_id") + i) % 7 != 0, (F.col("vec_id") * 7 + i * 31) % 101 / 100.0)

    for i, name in enumerate(_MODELS):
        registry.register(name, model(i))
    scores = registry.score_all(table(spark, sf, "embeddings"), "vec_id", load_dims(spark)["model"])
    return weighted_vote(scores, "vec_id").withColumn("vote", F.round("vote", 6))


@query("model_score_rows", f"""
WITH a(model_id, weight) AS (VALUES {_ACTIVE}), p AS (SELECT sample_id, unnest(['url_cnn_v1', 'text_nlp_v1', 'bodmas_v1']) AS model_id, unnest([url, nlp, structural]) AS r FROM ({PREDICTION_SQL}))
SELECT sample_id, p.model_id, CASE WHEN r > 0.9 THEN 0.0 ELSE r END AS risk, CASE WHEN r > 0.9 THEN 'FAILED' ELSE 'READY' END AS status FROM p JOIN a ON p.model_id = a.model_id""")
def model_score_rows(spark, sf):
    rows = predictions(spark, sf).select("sample_id", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model_id"), F.when(F.col(c) <= 0.9, F.col(c)).alias("risk"))
        for m, c in (("url_cnn_v1", "url"), ("text_nlp_v1", "nlp"), ("bodmas_v1", "structural"))])))
    return active_scores(rows, load_dims(spark)["model"]).select("sample_id", "model_id", "risk", "status")


@query("local_model_scores", f"""
SELECT sample_id, url_score, nlp_score, degraded, round(url_score * 0.6 + nlp_score * 0.4, 6) AS soft_vote, round(url_score * 0.6 + nlp_score * 0.4, 9) >= 0.72 AS flagged
FROM (SELECT sample_id, CASE WHEN url > 0.9 THEN 0.5 ELSE url END AS url_score, CASE WHEN nlp > 0.9 THEN 0.5 ELSE nlp END AS nlp_score,
  concat_ws(',', CASE WHEN url > 0.9 THEN 'url' END, CASE WHEN nlp > 0.9 THEN 'nlp' END) AS degraded FROM ({PREDICTION_SQL}))""")
def local_model_scores(spark, sf):
    p = local_scores(predictions(spark, sf), {
        "url": F.when(F.col("url") <= 0.9, F.col("url")), "nlp": F.when(F.col("nlp") > 0.9, F.lit(float("nan"))).otherwise(F.col("nlp"))})
    vote = fusion.soft_vote(F.col("url_score"), F.col("nlp_score"))
    return p.select("sample_id", "url_score", "nlp_score", F.array_join("degraded", ",").alias("degraded"), F.round(vote, 6).alias("soft_vote"),
                    fusion.soft_vote_flag(F.round(vote, 9)).alias("flagged"))


def _knots(i: int) -> str:
    xs, ys = lx.ISOTONIC_KNOTS[i]
    parts = [f"WHEN s <= {xs[0]!r} THEN {ys[0]!r}"]
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        parts.append(f"WHEN s <= {x1!r} THEN {y0!r} + (s - {x0!r}) * ({y1!r} - {y0!r}) / ({x1!r} - {x0!r})")
    return f"round(CAST(CASE {' '.join(parts)} ELSE {ys[-1]!r} END AS DOUBLE), 6)"


@query("calibrated_scores", f"SELECT sample_id, {_knots(0)} AS c0, {_knots(1)} AS c1, {_knots(2)} AS c2 FROM (SELECT sample_id, nlp AS s FROM ({PREDICTION_SQL}))")
def calibrated_scores(spark, sf):
    return predictions(spark, sf).select("sample_id", *[
        F.round(fusion.calibrate(F.col("nlp"), k), 6).alias(f"c{i}") for i, k in enumerate(lx.ISOTONIC_KNOTS)])


@query("probability_rules", f"""
SELECT sample_id, round(exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS softmax, round(CASE WHEN b BETWEEN 0 AND 1 THEN b ELSE 1 / (1 + exp(-b)) END, 6) AS squashed,
  round(url * 0.6 + nlp * 0.4, 6) AS soft_vote, round(url * 0.6 + nlp * 0.4, 9) >= 0.72 AS flagged
FROM (SELECT sample_id, url, nlp, url * 8 - 4 AS a, nlp * 8 - 4 AS b FROM ({PREDICTION_SQL}))""")
def probability_rules(spark, sf):
    p = predictions(spark, sf).withColumns({"a": F.col("url") * 8 - 4, "b": F.col("nlp") * 8 - 4})
    vote = fusion.soft_vote(F.col("url"), F.col("nlp"))
    return p.select("sample_id", F.round(fusion.two_class_softmax(F.col("a"), F.col("b")), 6).alias("softmax"),
                    F.round(fusion.to_probability(F.col("b")), 6).alias("squashed"), F.round(vote, 6).alias("soft_vote"),
                    fusion.soft_vote_flag(F.round(vote, 9)).alias("flagged"))


# -- message and region decisions ------------------------------------------

def _messages(spark, sf):
    score = lambda k: F.expr(f"CAST(email_id * {k} % 101 AS DOUBLE) / 100")
    m = mail(spark, sf).select("email_id", F.col("body_text").alias("text"), tx.extract_message_urls("body_text").alias("urls"))
    m = spoofed_links(m, "email_id")
    return m.withColumns({
        "url_score": F.when(F.size("urls") > 0, score(7)).otherwise(0.0), "nlp_score": score(13), "structural_score": score(3) * 0.3,
        "regional": F.lit(0.0), "reputation": score(5) * 0.5, "regional_language": tx.has_tamil("text"),
        "ai_score": F.when(F.col("email_id") % 3 == 0, (F.col("email_id") % 101).cast("int")),
        "cloud_score": F.when(F.col("email_id") % 4 == 0, (F.col("email_id") * 3 % 101).cast("int")),
        "trusted_links": F.forall("urls", lambda u: is_trusted_mobile(host_of(u)))})


def _scan_cte() -> str:
    from riskframe.plans.text_queries import _SIG_SQL, _SIG_SUM
    from riskframe.plans.url_queries import _NEAR, _reg

    host = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1))"
    sc = lambda k: f"CAST(email_id * {k} % 101 AS DOUBLE) / 100"
    return f"""
u AS (SELECT email_id, body_text AS t, list_distinct(list_transform(regexp_extract_all(body_text, {quoted(tx.MESSAGE_URL_PATTERN)}), lambda x: rtrim(x, '.,;'))) AS urls FROM ({MAIL_SQL})),
ho AS (SELECT email_id, {host} AS host FROM (SELECT email_id, unnest(urls) AS url FROM u)),
ro AS (SELECT email_id, {_reg('host')[0]} AS root, {_reg('host')[1]} AS prefix FROM ho WHERE host <> ''),
ty AS (SELECT email_id, bool_or(NOT {in_list('root', lx.OFFICIAL_ROOTS)} AND ((len(label) >= 4 AND ({_NEAR})) OR (prefix <> '' AND {has_any('prefix', lx.MOBILE_BRANDS)}))) AS typo
  FROM (SELECT *, split_part(root, '.', 1) AS label FROM ro) GROUP BY 1),
sg AS (SELECT email_id, {_SIG_SUM} AS n FROM (SELECT email_id, {_SIG_SQL} FROM u)),
i AS (SELECT u.email_id, t, lower(t) AS low, urls, n, coalesce(typo, false) AS typo, CASE WHEN len(urls) > 0 THEN {sc(7).replace('email_id', 'u.email_id')} ELSE 0 END AS us,
  {sc(13).replace('email_id', 'u.email_id')} AS ns0, {sc(3).replace('email_id', 'u.email_id')} * 0.3 AS ss0, {sc(5).replace('email_id', 'u.email_id')} * 0.5 AS rs,
  CASE WHEN u.email_id % 3 = 0 THEN CAST(u.email_id % 101 AS INT) END AS ai, CASE WHEN u.email_id % 4 = 0 THEN CAST(u.email_id * 3 % 101 AS INT) END AS cloud
  FROM u JOIN sg ON u.email_id = sg.email_id LEFT JOIN ty ON u.email_id = ty.email_id)"""


_REWARD = "(contains(low, 'cashback') AND (contains(low, 'wallet') OR contains(low, 'bill') OR contains(low, 'credited') OR contains(low, 'valid for')))"


def _message_sql() -> str:
    w = lx.DEFAULT_WEIGHTS
    everyday = f"({hit_count('low', lx.MESSAGE_BANK_TERMS)} >= 2 OR {hit_count('low', lx.MESSAGE_RETAILER_TERMS)} >= 2)"
    short = "len(list_filter(urls, lambda x: " + " OR ".join(f"contains(lower(x), {quoted(d)})" for d in lx.MOBILE_SHORTENERS) + ")) > 0"
    act = "list_filter([us, ns, ss, ts, rs], lambda x: x > 0)"
    return f"""
WITH {_scan_cte()},
a AS (SELECT *, CASE WHEN n < 2 AND us < 0.30 AND NOT typo AND {everyday} THEN least(ns0, 0.22) ELSE ns0 END AS ns, CASE WHEN {short} AND n >= 2 THEN greatest(ss0, 0.5) ELSE ss0 END AS ss,
  CASE WHEN typo THEN 1.0 ELSE 0.0 END AS ts FROM i),
b AS (SELECT *, CASE WHEN len({act}) >= 2 THEN list_stddev_pop({act}) ELSE 0 END AS d,
  CAST(floor(round(least(1, greatest(0, (us * {w['url']} + ns * {w['nlp']} + ss * {w['structural']} + ts * {w['typosquat']} + rs * {w['reputation']}) / {sum(w.values())!r})) * 100, 6)) AS INT) AS ml FROM a),
c AS (SELECT *, ml < 35 AND n < 2 AND us < 0.30 AND ts < 0.40 AND rs < 0.35 AS clean, least(100, greatest(0, CAST(floor(round(ml * 0.55 + ai * 0.45, 6)) AS INT))) AS mix FROM b),
e AS (SELECT *, CASE WHEN ai IS NULL THEN least(100, CAST(floor(round(ml * 1.1, 6)) AS INT)) WHEN clean AND ai >= 70 THEN CASE WHEN {_REWARD} THEN 28 ELSE 38 END
  WHEN clean AND ai >= 40 THEN least(mix, CASE WHEN {_REWARD} THEN 25 ELSE 35 END) WHEN clean THEN least(mix, 25) WHEN ml < 15 AND n < 2 AND mix >= 70 THEN 39
  WHEN ml < 10 AND mix >= 70 THEN 65 ELSE mix END AS bl, CAST(ns > 0.80 AS INT) + CAST(us > 0.85 AS INT) + CAST(ss > 0.85 AS INT) + CAST(ts > 0.5 AS INT) + CAST(rs > 0.4 AS INT) + CAST(coalesce(ai, 0) >= 40 AS INT) AS nf FROM c),
f AS (SELECT *, ts >= 0.9 AS ex, CASE WHEN ts >= 0.9 THEN bl WHEN nf < 1 THEN least(bl, 39) WHEN nf < 2 THEN least(bl, 69) ELSE bl END AS sc FROM e)
SELECT email_id, ml AS ml_score, round(d, 6) AS disagreement, CASE WHEN d > 0.35 AND greatest(us, ns, ss, ts, rs) < 0.70 THEN 'CONFLICTING_SIGNALS' WHEN d > 0.40 THEN 'SEVERE_DISAGREEMENT'
  WHEN len(urls) > 0 AND us < 0.10 AND ns > 0.70 AND ts < 0.10 AND ss < 0.10 THEN 'TEXT_ONLY_SIGNAL' END AS uncertainty_reason, bl AS blended_score, nf AS n_fired, ex AS gate_exempt,
  sc AS risk_score, CASE WHEN sc >= 70 THEN 'DANGER' WHEN sc >= 40 THEN 'WARNING' ELSE 'SAFE' END AS verdict FROM f"""


@query("message_scan", _message_sql())
def message_scan(spark, sf):
    out = fusion.corroboration_gate(fusion.external_blend(fusion.message_ensemble(_messages(spark, sf))))
    return out.select("email_id", "ml_score", F.round("disagreement", 6).alias("disagreement"), "uncertainty_reason", "blended_score",
                      F.size("fired_models").alias("n_fired"), "gate_exempt", "risk_score", "verdict")


def _region_sql() -> str:
    from riskframe.plans.text_queries import _BANK, _STRUCTURED

    octet = tx._OCTET
    bad = (f"(contains(lower(x), 'bit.ly') OR contains(lower(x), 'tinyurl') OR contains(lower(x), '.xyz') OR contains(lower(x), '.top/') OR ends_with(lower(x), '.top') "
           f"OR regexp_matches(lower(x), {quoted('^(?:https?://)?(?:' + octet + chr(92) + '.){3}' + octet + '(?::' + chr(92) + 'd{1,5})?(?:/' + chr(92) + 'S*)?$')}))")
    short = "(" + " OR ".join(f"contains(lower(x), {quoted(d)})" for d in lx.MOBILE_SHORTENERS) + ")"
    some = lambda cond: f"len(list_filter(urls, lambda x: {cond})) > 0"
    guards = (f"({hit_count('low', lx.ACADEMIC_TERMS)} >= 2 OR {_STRUCTURED.replace('(t,', '(low,')} OR {_BANK.replace('(t,', '(low,')} OR {hit_count('low', lx.RETAILER_TERMS)} >= 2)")
    pct = lambda e: f"least(100, greatest(0, CAST(floor(round(({e}) * 100, 6)) AS INT)))"
    return f"""
WITH {_scan_cte()},
a AS (SELECT *, contains(low, 'upi://pay') AND (contains(low, 'mode=collect') OR regexp_matches(low, '\\bcollect\\b')) AS fraud, n >= 2 AS corr, {some(bad)} AS badlink, len(urls) > 0 AS hasu,
  {_REWARD} AS reward, CASE WHEN typo THEN 0.95 ELSE 0.0 END AS tsc, {some(short)} AS shortl, {some(bad + ' AND NOT ' + short)} AS hardl, {guards} AS guard0 FROM i),
b AS (SELECT *, ({has_any('low', lx.SCAM_REQUEST_TERMS)} OR {has_any('low', lx.SCAM_LURE_TERMS)} OR badlink) AS scam, CASE WHEN fraud THEN 95 WHEN contains(low, 'upi://pay') THEN 40 ELSE 0 END AS upi FROM a),
c AS (SELECT *, CASE WHEN guard0 AND NOT scam AND NOT corr AND us < 0.40 AND ss0 < 0.40 AND tsc < 0.50 THEN least(ns0, 0.22) ELSE ns0 END AS en FROM b),
d AS (SELECT *, CASE WHEN hasu THEN {pct('us')} ELSE 0 END AS ui, {pct('en')} AS ni, {pct('ss0')} AS si, {pct('tsc')} AS ti FROM c),
e AS (SELECT *, CAST(floor(round((CASE WHEN upi > 0 THEN upi * 0.3 ELSE 0 END + CASE WHEN hasu THEN ui * 0.3 ELSE 0 END + ni * 0.4 + si * 0.2 + CASE WHEN ti > 0 THEN ti * 0.2 ELSE 0 END)
  / (CASE WHEN upi > 0 THEN 0.3 ELSE 0 END + CASE WHEN hasu THEN 0.3 ELSE 0 END + 0.4 + 0.2 + CASE WHEN ti > 0 THEN 0.2 ELSE 0 END), 6)) AS INT) AS edge FROM d),
f AS (SELECT *, CASE WHEN cloud IS NOT NULL THEN CAST(floor(round(edge * 0.6 + cloud * 0.4, 6)) AS INT) ELSE edge END AS b0, coalesce(cloud, 0) AS cl FROM e),
g AS (SELECT *, CASE WHEN fraud THEN greatest(b0, 85) ELSE b0 END AS b1, us >= 0.40 OR ss0 >= 0.70 OR tsc >= 0.50 OR hardl OR (shortl AND corr) AS tech FROM f),
h AS (SELECT *, NOT fraud AND NOT tech AND NOT corr AND cl < 60 AND us < 0.60 AS tonly, NOT fraud AND NOT tech AND NOT corr AND cl < 60 AND us < 0.60 AND NOT scam AND us < 0.30 AND ns0 < 0.40 AND ss0 < 0.30 AND tsc < 0.40 AS clean FROM g),
j AS (SELECT *, CASE WHEN tonly THEN least(b1, 29) ELSE b1 END AS b2 FROM h),
k AS (SELECT *, CASE WHEN clean AND cl >= 70 THEN CASE WHEN reward THEN 28 ELSE 38 END WHEN clean AND cl >= 40 THEN least(b2, CASE WHEN reward THEN 25 ELSE 35 END)
  WHEN clean THEN least(b2, CASE WHEN reward THEN 18 ELSE 25 END) WHEN NOT scam AND NOT corr AND us + ns0 + ss0 + tsc < 0.80 AND NOT fraud AND cl >= 70 THEN least(b2, 39) ELSE b2 END AS b3 FROM j),
l AS (SELECT *, CASE WHEN corr AND badlink THEN greatest(b3, 70) ELSE b3 END AS b4, greatest(upi, ui, si, ti, cl) AS peak FROM k),
o AS (SELECT *, CASE WHEN peak >= 85 THEN greatest(b4, CAST(floor(round(peak * 0.9, 6)) AS INT)) WHEN NOT tonly AND peak >= 60 THEN greatest(b4, CAST(floor(round(peak * 0.75, 6)) AS INT)) ELSE b4 END AS sc FROM l),
q AS (SELECT *, CASE WHEN fraud OR sc >= 70 THEN 'DANGER' WHEN sc >= 30 THEN 'WARNING' ELSE 'SAFE' END AS v0, upi >= 70 OR (hasu AND ui >= 70) OR ni >= 70 OR si >= 70 OR ti >= 70 OR cl >= 70 AS high FROM o),
r AS (SELECT *, CASE WHEN v0 = 'SAFE' AND high THEN 'WARNING' ELSE v0 END AS verdict FROM q)
SELECT email_id, sc AS risk_score, verdict, NOT (v0 = 'SAFE' AND high) AS is_complete FROM r"""


@query("region_scan", _region_sql())
def region_scan(spark, sf):
    df = _messages(spark, sf).withColumn("typosquat_score", F.when(F.col("typosquat") | F.col("homograph"), 0.95).otherwise(0.0))
    return fusion.hybrid_decision(df).select("email_id", "risk_score", "verdict", "is_complete")


@query("region_categories")
def region_categories(spark, sf):
    df = _messages(spark, sf).withColumn("typosquat_score", F.when(F.col("typosquat") | F.col("homograph"), 0.95).otherwise(0.0))
    return fusion.hybrid_decision(df).select("email_id", "category", F.array_join("risk_factors", "; ").alias("risk_factors"))


@query("risk_bands", f"""
WITH i AS (SELECT email_id, CAST(email_id * 17 % 101 AS INT) AS c, split_part('SAFE|PHISHING|FRAUD|SPAM|SPOOFED|SUSPICIOUS', '|', CAST(email_id % 6 AS INT) + 1) AS cat,
  split_part('|spf=pass; dkim=pass; dmarc=pass|spf=fail; dkim=fail; dmarc=fail|spf=softfail', '|', CAST(email_id % 4 AS INT) + 1) AS h, email_id % 5 = 0 AS fwd FROM ({MAIL_SQL})),
a AS (SELECT *, CASE email_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 99 ELSE 45 END AS au, h <> '' AS known, cat IN ('PHISHING', 'SPOOFED') AS mim FROM i),
b AS (SELECT *, CASE WHEN known THEN CASE WHEN mim OR c >= 40 THEN greatest(c, CAST(floor(round(c * 0.6 + au * 0.4, 6)) AS INT)) ELSE CAST(floor(round(c * 0.6 + au * 0.4, 6)) AS INT) END ELSE c END AS s0 FROM a),
f AS (SELECT *, CASE WHEN mim OR c >= 70 OR cat = 'FRAUD' THEN greatest(s0, c) ELSE s0 END AS s1 FROM b),
g AS (SELECT *, CASE WHEN mim THEN greatest(s1, 85) ELSE s1 END AS s2 FROM f),
k AS (SELECT *, least(100, CASE WHEN fwd AND c >= 40 AND s2 < c THEN c ELSE s2 END) AS risk_score FROM g),
v AS (SELECT *, CASE WHEN c < 30 AND au < 30 AND NOT mim THEN 'SAFE' WHEN risk_score >= 70 OR cat = 'PHISHING' OR mim THEN 'MALICIOUS' WHEN risk_score >= 45 THEN 'SUSPICIOUS'
  WHEN risk_score >= 20 THEN 'UNVERIFIED' ELSE 'SAFE' END AS v0 FROM k)
SELECT email_id, au AS auth_score, risk_score, CASE WHEN v0 = 'SAFE' AND c >= 40 THEN CASE WHEN c >= 70 THEN 'MALICIOUS' ELSE 'SUSPICIOUS' END ELSE v0 END AS verdict FROM v""")
def risk_bands(spark, sf):
    from riskframe.functions.headers import parse_auth

    df = mail(spark, sf).selectExpr(
        "email_id", "CAST(email_id * 17 % 101 AS INT) AS content_score",
        "split_part('SAFE|PHISHING|FRAUD|SPAM|SPOOFED|SUSPICIOUS', '|', CAST(email_id % 6 AS INT) + 1) AS primary_category",
        "split_part('|spf=pass; dkim=pass; dmarc=pass|spf=fail; dkim=fail; dmarc=fail|spf=softfail', '|', CAST(email_id % 4 AS INT) + 1) AS h",
        "email_id % 5 = 0 AS is_forwarded", "false AS mimicry").withColumn("auth", parse_auth("h"))
    return fusion.email_risk(df).select("email_id", "auth_score", "risk_score", "verdict")


# -- training --------------------------------------------------------------

@query("tfidf_weights", """
WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\W+'), lambda w: w <> '')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY 1, 2), d AS (SELECT w, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(*) AS n FROM documents)
SELECT c.doc_id, count(*) AS n_terms, round(sum(tf * ln((n + 1.0) / (df + 1.0))), 4) AS weight_sum FROM c JOIN d ON c.w = d.w, n GROUP BY 1""")
def tfidf_weights(spark, sf):
    terms = ml.tfidf(table(spark, sf, "documents").select("doc_id", "text"))
    return terms.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 4).alias("weight_sum"))


@query("stratified_split", """
WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY sha256(concat('42:', doc_id)), doc_id) AS rn, count(*) OVER (PARTITION BY toxic) AS n FROM labels)
SELECT doc_id, toxic, rn - 1 < floor(n * 0.8) AS is_train FROM r""")
def stratified_split(spark, sf):
    return ml.stratified_split(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 0.8)


@query("time_folds", f"SELECT id, CAST(ntile(4) OVER (ORDER BY ts, id) AS INT) AS tile FROM ({SCAN_SQL})")
def time_folds(spark, sf):
    return ml.time_folds(scans(spark, sf).select("ts", "id"), ["ts", "id"], 3).select("id", "tile")


@query("feature_metadata", """
SELECT 'train' AS subset, count(*) AS n, min(sha256(CAST(vec_id AS VARCHAR))) AS first_sha FROM embeddings WHERE vec_id % 4 <> 0 AND label <> 1
UNION ALL SELECT 'test', count(*), min(sha256(CAST(vec_id AS VARCHAR))) FROM embeddings WHERE vec_id % 4 = 0 AND label <> 1""")
def feature_metadata(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.sha2(F.col("vec_id").cast("string"), 256).alias("sha256"), F.when(F.col("label") == 1, -1).otherwise(F.col("label")).alias("label"))
    meta = build_metadata(rows.filter("vec_id % 4 <> 0").drop("vec_id"), rows.filter("vec_id % 4 = 0").drop("vec_id"))
    return labelled(meta).groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.min("sha256").alias("first_sha"))


@query("url_classifier")
def url_classifier(spark, sf):
    from riskframe.functions.urls import url_assessment

    feats = lexical_features("url")
    rows = links(spark, sf).select(
        "link_id", (url_assessment("url")["risk_score"] >= 70).cast("int").alias("label"), *[c.cast("double").alias(n) for n, c in feats.items()])
    train = ml.stratified_split(rows, "label", "link_id", 0.8)
    data = ml.assemble(train, list(feats)).select("link_id", "label", "features", "is_train", (F.pmod(F.xxhash64("link_id"), F.lit(5)) == 0).alias("is_valid"))
    # Early stopping looks at a part of the training rows; the test rows take no part in it.
    model = ml.boosted_trees(rounds=5, validation="is_valid").fit(data.filter("is_train"))
    scored = ml.score_vectors(model, data.filter("NOT is_train"), 0.60, width=len(feats))
    return scored.select("link_id", "label", F.round("probability", 6).alias("probability"), "prediction")


@query("grid_search")
def grid_search(spark, sf):
    from riskframe.functions.urls import url_assessment

    feats = lexical_features("url")
    rows = links(spark, sf).select(
        "link_id", (url_assessment("url")["risk_score"] >= 70).cast("double").alias("label"), *[c.cast("double").alias(n) for n, c in feats.items()])
    data = ml.assemble(rows, list(feats)).select("label", "features", F.pmod(F.xxhash64("link_id"), F.lit(3)).cast("int").alias("fold"))
    fitted = ml.grid_search(data, folds=3, fold_col="fold", rounds=(2, 5), rates=(0.05, 0.1))
    return ml.grid_report(spark, fitted).withColumn("mean_auc", F.round("mean_auc", 6))


@query("sql_functions", f"""
SELECT email_id, CASE WHEN contains(sender, '@') THEN concat(CASE WHEN len(split_part(sender, '@', 1)) > 1 THEN concat(left(sender, 1), '***') ELSE '***' END, '@', split_part(sender, '@', 2)) ELSE sender END AS masked,
  CASE WHEN regexp_extract(lower(authentication_results), 'spf\\s*=\\s*(pass|fail|softfail|neutral|none|temperror|permerror|bestguesspass)', 1) = '' THEN 'UNKNOWN'
    ELSE upper(regexp_extract(lower(authentication_results), 'spf\\s*=\\s*(pass|fail|softfail|neutral|none|temperror|permerror|bestguesspass)', 1)) END AS spf,
  split_part('PUBLIC|PRIVATE|INVALID|LOOPBACK|LOOPBACK|PUBLIC|PRIVATE', '|', CAST(email_id % 7 AS INT) + 1) AS address_class FROM ({MAIL_SQL})""")
def sql_functions(spark, sf):
    register_functions(spark)
    return mail(spark, sf).selectExpr(
        "email_id", "mask_email(sender) AS masked", "auth_status(authentication_results, 'SPF') AS spf",
        "ip_class(split_part('8.8.8.8|10.0.0.1|1.2.3|127.0.0.1|::1|2a00:1450:4009::8a|fd12::1', '|', CAST(email_id % 7 AS INT) + 1)) AS address_class")
