from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.functions import fusion
from riskframe.functions.headers import parse_auth
from riskframe.operators import evaluation as ev
from riskframe.operators.signals import SignalRegistry, weighted_vote
from riskframe.operators.triage import triage
from riskframe.sources.tables import load_dims


def risk(spark, content, auth="", category="SAFE", mimic=False, fwd=False, **kw):
    df = spark.createDataFrame([(content, auth, category, mimic, fwd)], "content_score int, a string, primary_category string, mimicry boolean, is_forwarded boolean")
    r = fusion.email_risk(df.withColumn("auth", parse_auth("a")), **kw).first()
    return r["risk_score"], r["verdict"]


def test_email_risk(spark):
    passed = "spf=pass; dkim=pass; dmarc=pass"
    assert risk(spark, 0) == (0, "SAFE")
    assert risk(spark, 25, passed) == (15, "SAFE")
    assert risk(spark, 10, passed, allow_verified=True) == (6, "VERIFIED")
    assert risk(spark, 50, passed) == (50, "SUSPICIOUS")
    assert risk(spark, 30, "spf=fail; dkim=fail; dmarc=fail") == (57, "SUSPICIOUS")
    assert risk(spark, 50, passed, "PHISHING") == (85, "MALICIOUS")
    assert risk(spark, 72, "", "FRAUD", fwd=True) == (72, "MALICIOUS")


def test_triage_rows(spark):
    cols = "email_id int, sender string, reply_to string, return_path string, subject string, body_text string, authentication_results string, raw_headers map<string,string>"
    rows = [(1, "", "", "", "", "", "", {}), (2, "PayPal <x@evil.com>", "", "", "Urgent", "verify your account http://paypa1.com/login", "", {}),
            (3, "a@corp.com", "", "", "Hi", "password: hunter2secret", "", {}), (4, "a@corp.com", "", "", "Hi", "lunch?", "", {"resent-from": "b"})]
    got = {r["email_id"]: r for r in triage(spark.createDataFrame(rows, cols)).collect()}
    assert (got[1]["risk_score"], got[1]["verdict"]) == (0, "SAFE")
    assert got[2]["verdict"] == "MALICIOUS" and got[2]["primary_category"] == "PHISHING"
    assert got[3]["primary_category"] == "SENSITIVE_DATA_EXPOSURE" and got[3]["content_score"] == 95
    assert "hunter2secret" not in got[3]["summary"]
    assert got[4]["is_forwarded"] and got[4]["verdict"] == "SAFE"


def _message(spark, text, urls=(), **scores):
    values = {"url_score": 0.0, "nlp_score": 0.0, "structural_score": 0.0, "typosquat": False, "homograph": False, "regional": 0.0,
              "reputation": 0.0, "regional_language": False, "ai_score": None, **scores}
    df = spark.range(1).select(F.lit(text).alias("text"), F.array(*[F.lit(u) for u in urls]).cast("array<string>").alias("urls"),
                               *[(F.lit(v).cast("int") if k == "ai_score" else F.lit(v)).alias(k) for k, v in values.items()])
    return fusion.corroboration_gate(fusion.external_blend(fusion.message_ensemble(df))).first()


def test_one_model_cannot_alarm(spark):
    r = _message(spark, "hello there, how are you doing today", nlp_score=1.0)
    assert len(r["fired_models"]) == 1 and r["risk_score"] <= 69
    r = _message(spark, "your account was debited rs.500, txn ref", nlp_score=0.95)
    assert abs(r["nlp"] - 0.22) < 1e-9 and r["verdict"] == "SAFE"
    r = _message(spark, "urgent click now", ["https://bit.ly/x"], structural_score=0.1)
    assert r["structural"] == 0.5
    r = _message(spark, "x", ["http://paypa1.com"], typosquat=True, url_score=0.9, nlp_score=0.9, structural_score=0.9)
    assert r["gate_exempt"] and r["verdict"] == "DANGER"


def test_clean_local_evidence_holds_cloud_back(spark):
    assert _message(spark, "cashback credited in wallet", ai_score=90)["blended_score"] == 28
    assert _message(spark, "see you at noon tomorrow", ai_score=90)["blended_score"] == 38


def _region(spark, text, urls=(), cloud=None, **scores):
    values = {"url_score": 0.0, "nlp_score": 0.0, "structural_score": 0.0, "typosquat_score": 0.0, **scores}
    df = spark.range(1).select(F.lit(text).alias("text"), F.array(*[F.lit(u) for u in urls]).cast("array<string>").alias("urls"),
                               F.lit(cloud).cast("int").alias("cloud_score"), *[F.lit(v).alias(k) for k, v in values.items()])
    return fusion.hybrid_decision(df).first()


def test_region_decisions(spark):
    r = _region(spark, "pay upi://pay?pa=x&mode=collect")
    assert r["verdict"] == "DANGER" and r["risk_score"] >= 85 and r["category"] == "OTP_FRAUD"
    r = _region(spark, "department of physics semester exam schedule", nlp_score=0.9)
    assert r["verdict"] == "SAFE"
    r = _region(spark, "hello friend", nlp_score=0.95)
    assert r["risk_score"] == 29 and r["verdict"] == "WARNING" and not r["is_complete"]
    r = _region(spark, "urgent verify now", ["http://bad.xyz/a"], url_score=0.2, nlp_score=0.5)
    assert r["risk_score"] >= 70 and r["category"] == "PHISHING"
    r = _region(spark, "jiomart cashback credited in wallet", cloud=85, nlp_score=0.2)
    assert r["risk_score"] == int(85 * 0.9)


def test_numeric_rules(one):
    assert abs(one(fusion.two_class_softmax(F.lit(1000.0), F.lit(1001.0))) - 0.7310585786) < 1e-9
    assert one(fusion.to_probability(F.lit(float("nan")))) == 0.0 and one(fusion.to_probability(F.lit(0.3))) == 0.3
    xs, ys = lx.ISOTONIC_KNOTS[0]
    assert one(fusion.calibrate(F.lit(2.0), (xs, ys))) == ys[-1] and one(fusion.calibrate(F.lit(0.0), (xs, ys))) == ys[0]
    assert abs(one(fusion.calibrate(F.lit(xs[2]), (xs, ys))) - ys[2]) < 1e-12
    assert one(fusion.file_score(F.lit(50), F.lit(70), F.lit(False))) == 70
    assert one(fusion.file_score(F.lit(50), F.lit(10), F.lit(False))) == 50
    assert one(fusion.safe_bool(F.lit("Detected"))) and not one(fusion.safe_bool(F.lit("absent")))


def test_feedback_step():
    w = [lx.DEFAULT_WEIGHTS[c] for c in lx.COMPONENTS]
    down = fusion.weight_step(w, [0.9, 0.1, 0.1, 0.1, 0.1], "DANGER", False)
    up = fusion.weight_step(w, [0.9, 0.1, 0.1, 0.1, 0.1], "DANGER", True)
    assert down[0] < w[0] < up[0] and abs(down.sum() - 1) < 1e-9
    same = fusion.weight_step(w, [0.9, 0.1, 0.1, 0.1, 0.1], "SAFE", True)
    assert abs(same - w).max() < 1e-9


def test_signal_plugins_fail_alone(spark):
    reg = SignalRegistry()
    reg.register("url_cnn_v1", lambda df: F.col("x") / 10)
    reg.register("text_nlp_v1", lambda df: F.col("t").try_cast("double"))
    reg.register("bodmas_v1", lambda df: F.lit(1.0))
    rows = reg.score_all(spark.createDataFrame([(1, 5, "bad"), (2, 5, "1.0")], "id int, x int, t string"), "id", load_dims(spark)["model"])
    assert {(r["id"], r["model_id"], r["status"]) for r in rows.collect()} == {
        (1, "url_cnn_v1", "READY"), (1, "text_nlp_v1", "FAILED"), (2, "url_cnn_v1", "READY"), (2, "text_nlp_v1", "READY")}
    votes = {r["id"]: r["vote"] for r in weighted_vote(rows, "id").collect()}
    assert abs(votes[1] - 0.5) < 1e-9 and abs(votes[2] - (0.5 * 0.35 + 0.25) / 0.6) < 1e-9


def test_exact_auc_with_ties(spark):
    import random
    rng = random.Random(1)
    data = [(rng.randrange(8), rng.random() < 0.4) for _ in range(300)]
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame([(s, int(y)) for s, y in data], "score int, label int").repartition(5)
    assert abs(ev.exact_auc(df).first()["auc"] - want) < 1e-9


def test_undefined_rates_read_zero(spark):
    df = spark.createDataFrame([("SAFE", "SAFE")], "expected string, verdict string")
    r = ev.binary_metrics(df).first()
    assert (r["tn"], r["precision"], r["recall"], r["f1"], r["accuracy"]) == (1, 0.0, 0.0, 0.0, 1.0)


def test_each_source_can_change_the_verdict(spark):
    from datetime import date

    from pyspark.sql import functions as F

    from riskframe.operators.triage import full_triage

    mails = [(1, "a@old.org", "see you at lunch", ""), (2, "a@young.org", "see you at lunch", ""), (3, "a@old.org", "see you at lunch", ""),
             (4, "a@old.org", "see you at lunch", '<a href="http://evil.net/x">https://bank.example.com/</a>'), (5, "a@old.org", "see http://paypa1.com/login", ""),
             (6, "a@old.org", "see you at lunch", ""), (7, "a@nomx.org", "see you at lunch", ""), (8, "a@netfl1x.com", "see you at lunch", "")]
    df = spark.createDataFrame([(i, s, "", "", "hi", b, "", h) for i, s, b, h in mails],
                               "email_id int, sender string, reply_to string, return_path string, subject string, body_text string, authentication_results string, body_html string")
    domains = spark.createDataFrame([("old.org", "R", date(2010, 1, 1), True), ("young.org", "R", date(2024, 5, 20), True), ("nomx.org", "R", date(2010, 1, 1), False)],
                                    "domain string, registrar string, creation_date date, has_mx boolean")
    files = spark.createDataFrame([(3, "a.pdf", "application/pdf", "AB" * 32, False), (6, "b.zip", "", "cd" * 32, True), (6, "c.txt", "", "ee" * 32, False)],
                                  "email_id int, filename string, content_type string, sha256 string, is_encrypted boolean")
    bad = spark.createDataFrame([("ab" * 32,)], "sha256 string")
    got = {r["email_id"]: r for r in full_triage(df, "email_id", domains, F.lit("2024-06-01").cast("date"), files, bad).select(
        "email_id", "verdict", "content_score", "primary_category", "risk_factors").collect()}
    assert [(i, r["verdict"], r["content_score"]) for i, r in sorted(got.items())] == [
        (1, "SAFE", 0), (2, "MALICIOUS", 85), (3, "MALICIOUS", 100), (4, "SUSPICIOUS", 55), (5, "MALICIOUS", 90), (6, "MALICIOUS", 75),
        (7, "SUSPICIOUS", 60), (8, "MALICIOUS", 90)]
    assert got[3]["primary_category"] == "MALWARE" and "SHA-256" in got[3]["risk_factors"][0]
