"""Score fusion and verdict rules as staged columns.

Each rule takes a DataFrame with documented input columns and adds its result
columns. Stages are separate ``withColumns`` calls so that a later stage can
name an earlier one; Catalyst merges them into one projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.functions.common import any_of, clamp, compact, contains_any, truncated
from riskframe.functions.headers import auth_score, has_auth
from riskframe.functions.text import (
    collect_fraud, context_guards, payment_link_score, reward_context, shortened_link, signal_count,
    strong_scam_evidence, suspicious_link, text_signals,
)

DANGER_MIN, WARNING_MIN = 70, 40
FILE_MALICIOUS_MIN, FILE_SUSPICIOUS_MIN = 60, 20


def three_band(score: Column) -> Column:
    return F.when(score >= DANGER_MIN, "DANGER").when(score >= WARNING_MIN, "WARNING").otherwise("SAFE")


def direct_verdict(score: Column) -> Column:
    return F.when(score >= 45, "SUSPICIOUS").when(score >= 20, "UNVERIFIED").otherwise("SAFE")


def file_verdict(score: Column) -> Column:
    return (
        F.when(score >= FILE_MALICIOUS_MIN, "MALICIOUS").when(score >= FILE_SUSPICIOUS_MIN, "SUSPICIOUS")
        .otherwise("SAFE")
    )


# -- content categories ----------------------------------------------------

def primary_category(categories: Column, risk: Column) -> Column:
    ordered = [F.when(F.array_contains(categories, c), F.lit(c)) for c in lx.CATEGORY_PRIORITY]
    return F.coalesce(*ordered, F.when(risk >= 30, "SUSPICIOUS"), F.lit("SAFE"))


def secondary_categories(categories: Column, primary: Column) -> Column:
    return F.array_sort(F.array_except(F.array_distinct(categories), F.array(primary)))


# -- domain intelligence signals -------------------------------------------

def domain_signals(df: DataFrame) -> DataFrame:
    """Scores of the registration, MX and imitation signals.

    Needs ``sender, domain, age_days, has_mx, domain_status, sender_imitation,
    url_imitation`` (the last two boolean, all nullable).
    """
    from riskframe.functions.urls import is_trusted_host

    domain = F.lower(F.coalesce(F.col("domain"), F.lit("")))
    known = (
        is_trusted_host(domain) | contains_any(domain, lx.EDUCATION_KEYWORDS)
        | contains_any(F.lower(F.coalesce(F.col("sender"), F.lit(""))), lx.EDUCATION_KEYWORDS)
    )
    imitation = F.coalesce(F.col("sender_imitation"), F.lit(False))
    age = F.col("age_days")
    registration = (
        F.when(known, 0).when(imitation, 90).when(age < 30, 85).when(age < 90, 40).otherwise(0))
    no_mx = ~F.coalesce(F.col("has_mx"), F.lit(True)) & (F.col("domain_status") == "RESOLVED")
    real = domain.contains(".") & (F.length(domain) > 4)
    return df.withColumns({
        "registration_score": registration,
        "mx_score": F.when(~known & F.coalesce(no_mx, F.lit(False)) & real, 60).otherwise(0),
        "url_imitation_score": F.when(F.coalesce(F.col("url_imitation"), F.lit(False)), 90).otherwise(0),
        "domain_categories": F.array_distinct(F.concat(
            F.when((~known & imitation) | F.coalesce(F.col("url_imitation"), F.lit(False)),
                   F.array(F.lit("PHISHING"), F.lit("IMPERSONATION"))).otherwise(F.array().cast("array<string>")),
            F.when(~known & ~imitation & F.coalesce(age < 30, F.lit(False)), F.array(F.lit("SUSPICIOUS")))
            .otherwise(F.array().cast("array<string>")))),
    })


# -- e-mail risk -----------------------------------------------------------

_MIMICRY = ["PHISHING", "IMPERSONATION", "SPOOFED", "BEC", "MALWARE"]


def email_risk(df: DataFrame, allow_verified: bool = False) -> DataFrame:
    """Fuse content and authentication into a 0-100 score and a four-band verdict.

    Needs ``auth`` (``parse_auth``), ``content_score``, ``primary_category``,
    ``mimicry`` (imitation named by a risk factor) and ``is_forwarded``. The
    relay anomaly is reported elsewhere and never scored. ``VERIFIED`` is only
    issued with ``allow_verified``.
    """
    df = df.withColumns({
        "auth_score": auth_score(F.col("auth")), "auth_known": has_auth(F.col("auth")),
        "_mimic": F.col("mimicry") | F.col("primary_category").isin(_MIMICRY),
    })
    content, auth = F.col("content_score"), F.col("auth_score")
    blended = truncated(content * 0.60 + auth * 0.40)
    strong = F.col("_mimic") | (content >= 40)
    base = F.when(F.col("auth_known"), F.when(strong, F.greatest(content, blended)).otherwise(blended)).otherwise(content)
    floor = F.col("_mimic") | (content >= 70) | F.col("primary_category").isin(
        [*_MIMICRY, "SENSITIVE_DATA_EXPOSURE", "FRAUD"])
    df = df.withColumn("_s", F.when(floor, F.greatest(base, content)).otherwise(base))
    df = df.withColumn("_s", F.when(F.col("_mimic"), F.greatest(F.col("_s"), F.lit(85))).otherwise(F.col("_s")))
    lifted = F.col("is_forwarded") & (content >= 40) & (F.col("_s") < content)
    df = df.withColumns({
        "forwarded_floor": lifted,
        "risk_score": clamp(F.when(lifted, content).otherwise(F.col("_s"))).cast("int"),
    })
    score, mimic = F.col("risk_score"), F.col("_mimic")
    confirmed = F.col("primary_category").isin("SENSITIVE_DATA_EXPOSURE", "PHISHING", "MALWARE", "BEC", "IMPERSONATION")
    banded = (
        F.when((score >= 70) | confirmed | mimic, "MALICIOUS").when(score >= 45, "SUSPICIOUS")
        .when(score >= 20, "UNVERIFIED").otherwise("SAFE"))
    clean = (content < 30) & (auth < 30) & ~mimic
    verdict = F.when(clean, "SAFE").otherwise(banded)
    if allow_verified:
        all_pass = (F.col("auth.spf") == "PASS") & (F.col("auth.dkim") == "PASS") & (F.col("auth.dmarc") == "PASS")
        verdict = F.when(all_pass & (content <= 15) & ~mimic, "VERIFIED").otherwise(verdict)
    df = df.withColumn("verdict", verdict)
    silent = F.col("verdict").isin("SAFE", "VERIFIED") & ((content >= 40) | mimic)
    df = df.withColumn("verdict", F.when(
        silent, F.when((content >= 70) | mimic, "MALICIOUS").otherwise("SUSPICIOUS")).otherwise(F.col("verdict")))
    band = (
        F.when(F.col("verdict") == "MALICIOUS", "HIGH").when(F.col("verdict") == "SUSPICIOUS", "MEDIUM-HIGH")
        .when(F.col("verdict") == "UNVERIFIED", "MEDIUM").otherwise("LOW"))
    return df.withColumn("risk_band", band).drop("_mimic", "_s")


def summary_line(verdict: Column, factors: Column) -> Column:
    return (
        F.when(verdict == "VERIFIED", "Email authenticated (SPF+DKIM+DMARC pass)")
        .when(verdict == "SAFE", "No significant threats detected")
        .otherwise(F.array_join(F.slice(factors, 1, 3), "; "))
    )


# -- message ensemble ------------------------------------------------------

def active_std(scores: list[Column]) -> Column:
    """Population standard deviation of the scores above zero (0 with fewer than two)."""
    active = [F.when(s > 0, s) for s in scores]
    n = reduce(lambda a, b: a + b, [F.when(s > 0, 1).otherwise(0) for s in scores])
    total = reduce(lambda a, b: a + b, [F.coalesce(a, F.lit(0.0)) for a in active])
    mean = total / F.greatest(n, F.lit(1))
    square = reduce(lambda a, b: a + b, [F.coalesce(F.pow(a - mean, F.lit(2.0)), F.lit(0.0)) for a in active])
    return F.when(n >= 2, F.sqrt(square / n)).otherwise(0.0)


def message_ensemble(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted local score of a message.

    Needs ``text, urls, url_score, nlp_score, structural_score, typosquat,
    homograph, regional, reputation``; adds the effective component scores,
    ``ensemble``, ``ml_score``, ``disagreement`` and ``uncertainty_reason``.
    """
    w = weights or lx.DEFAULT_WEIGHTS
    df = df.withColumns({"_lower": F.lower(F.coalesce(F.col("text"), F.lit(""))), "signals": text_signals("text")})
    corroborated = signal_count(F.col("signals")) >= 2
    imitation = F.col("typosquat") | F.col("homograph")
    lower = F.col("_lower")
    from riskframe.functions.common import hit_count

    everyday = (hit_count(lower, lx.MESSAGE_BANK_TERMS) >= 2) | (hit_count(lower, lx.MESSAGE_RETAILER_TERMS) >= 2)
    capped = ~corroborated & (F.col("url_score") < 0.30) & ~imitation & everyday
    nlp = F.when(capped, F.least(F.col("nlp_score"), F.lit(0.22))).otherwise(F.col("nlp_score"))
    short = F.exists(F.col("urls"), shortened_link)
    df = df.withColumns({
        "signal_count": signal_count(F.col("signals")),
        "nlp": F.greatest(nlp, F.col("regional")),
        "structural": F.when(short & corroborated, F.greatest(F.col("structural_score"), F.lit(0.5)))
        .otherwise(F.col("structural_score")),
        "typo": F.when(imitation, 1.0).otherwise(0.0),
    })
    parts = {"url": F.col("url_score"), "nlp": F.col("nlp"), "structural": F.col("structural"),
             "typosquat": F.col("typo"), "reputation": F.col("reputation")}
    total_weight = max(sum(w[c] for c in lx.COMPONENTS), 0.01)
    weighted = reduce(lambda a, b: a + b, [parts[c] * F.lit(w[c]) for c in lx.COMPONENTS])
    df = df.withColumns({
        "ensemble": clamp(weighted / F.lit(total_weight), 0.0, 1.0),
        "disagreement": active_std([parts[c] for c in lx.COMPONENTS]),
    })
    peak = F.greatest(*parts.values())
    d = F.col("disagreement")
    reason = (
        F.when((d > 0.35) & (peak < 0.70), "CONFLICTING_SIGNALS")
        .when(d > 0.40, "SEVERE_DISAGREEMENT")
        .when((F.size("urls") > 0) & (F.col("url_score") < 0.10) & (F.col("nlp") > 0.70)
              & (F.col("typo") < 0.10) & (F.col("structural") < 0.10), "TEXT_ONLY_SIGNAL")
    )
    return df.withColumns({
        "ml_score": clamp(truncated(F.round(F.col("ensemble") * 100, 6))).cast("int"), "uncertainty_reason": reason,
    }).drop("_lower")


def external_blend(df: DataFrame) -> DataFrame:
    """Blend the local score with an optional external one (``ai_score``, NULL when absent)."""
    local, ai = F.col("ml_score"), F.col("ai_score")
    corroborated = F.col("signal_count") >= 2
    reward = reward_context(F.lower(F.coalesce(F.col("text"), F.lit(""))))
    clean = (
        (local < 35) & ~corroborated & (F.col("url_score") < 0.30) & (F.col("typo") < 0.40)
        & (F.col("reputation") < 0.35))
    mixed = clamp(truncated(F.round(local * 0.55 + ai * 0.45, 6)))
    guarded = (
        F.when(clean & (ai >= 70), F.when(reward, 28).otherwise(38))
        .when(clean & (ai >= 40), F.least(mixed, F.when(reward, 25).otherwise(35)))
        .when(clean, F.least(mixed, F.lit(25)))
        .when((local < 15) & ~corroborated & (mixed >= DANGER_MIN), 39)
        .when((local < 10) & (mixed >= DANGER_MIN), 65)
        .otherwise(mixed)
    )
    alone = clamp(truncated(F.round(local * 1.1, 6)))
    return df.withColumn("blended_score", F.when(ai.isNull(), alone).otherwise(guarded).cast("int"))


def corroboration_gate(df: DataFrame) -> DataFrame:
    """Cap a score that too few independent models support; adds score and verdict.

    Needs the ensemble columns, ``blended_score`` and ``regional_language``.
    """
    fired = compact(
        F.when(F.col("nlp") > 0.80, F.lit("Text NLP")),
        F.when(F.col("url_score") > 0.85, F.lit("URL CNN")),
        F.when(F.col("structural") > 0.85, F.lit("Heuristic Core")),
        F.when(F.col("typo") > 0.5, F.lit("Brand Impersonation")),
        F.when(F.col("reputation") > 0.4, F.lit("Sender Reputation")),
        F.when(F.col("ai_score") >= 40, F.lit("Cloud AI")),
    )
    exempt = (F.col("typo") >= 0.9) | ((F.col("nlp") >= 0.70) & F.col("regional_language"))
    df = df.withColumns({"fired_models": fired, "gate_exempt": exempt})
    score = F.col("blended_score")
    final = (
        F.when(F.col("gate_exempt"), score)
        .when(F.size("fired_models") < 1, F.least(score, F.lit(WARNING_MIN - 1)))
        .when(F.size("fired_models") < 2, F.least(score, F.lit(DANGER_MIN - 1)))
        .otherwise(score)
    )
    return df.withColumn("risk_score", final.cast("int")).withColumn("verdict", three_band(F.col("risk_score")))


# -- region scan -----------------------------------------------------------

_COMPONENT = "struct<label:string,score:int,weight:double>"


def hybrid_decision(df: DataFrame) -> DataFrame:
    """Decide on a scanned screen region.

    Needs ``text, urls, url_score, nlp_score, structural_score, typosquat_score``
    and ``cloud_score`` (NULL when absent).
    """
    pct = lambda c: clamp(truncated(F.round(c * 100, 6))).cast("int")
    df = df.withColumns({
        "_lower": F.lower(F.coalesce(F.col("text"), F.lit(""))), "_signals": text_signals("text"),
        "_upi": payment_link_score("text"), "_fraud": collect_fraud("text"),
    })
    lower, urls = F.col("_lower"), F.col("urls")
    df = df.withColumns({
        "_guards": context_guards(lower), "_scam": strong_scam_evidence(lower, urls),
        "_corr": signal_count(F.col("_signals")) >= 2, "_badlink": F.exists(urls, suspicious_link),
        "_has_urls": F.size(urls) > 0, "_cloud": F.coalesce(F.col("cloud_score"), F.lit(0)),
        "_reward": reward_context(lower),
    })
    g = F.col("_guards")
    url, struct_s, typo = F.col("url_score"), F.col("structural_score"), F.col("typosquat_score")
    guard = (
        (g["academic"] | g["structured"] | g["bank"] | g["retailer"]) & ~F.col("_scam") & ~F.col("_corr")
        & (url < 0.40) & (struct_s < 0.40) & (typo < 0.50))
    df = df.withColumn("_nlp", F.when(guard, F.least(F.col("nlp_score"), F.lit(0.22))).otherwise(F.col("nlp_score")))
    df = df.withColumns({
        "_u": F.when(F.col("_has_urls"), pct(url)).otherwise(0), "_n": pct(F.col("_nlp")),
        "_st": pct(struct_s), "_t": pct(typo),
    })
    part = lambda label, s, w: F.struct(F.lit(label).alias("label"), s.cast("int").alias("score"), F.lit(w).alias("weight"))
    components = F.array_compact(F.array(
        F.when(F.col("_upi") > 0, part("payment_link", F.col("_upi"), 0.30)),
        F.when(F.col("_has_urls"), part("url", F.col("_u"), 0.30)),
        part("text", F.col("_n"), 0.40), part("structural", F.col("_st"), 0.20),
        F.when(F.col("_t") > 0, part("typosquat", F.col("_t"), 0.20)),
    ))
    df = df.withColumn("components", components)
    sums = F.aggregate(
        F.col("components"), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")),
        lambda a, c: F.struct((a["s"] + c["score"] * c["weight"]).alias("s"), (a["w"] + c["weight"]).alias("w")))
    df = df.withColumn("_sums", sums)
    df = df.withColumn("_edge", clamp(truncated(F.round(F.col("_sums.s") / F.col("_sums.w"), 6))))
    cloud = F.col("cloud_score")
    df = df.withColumn("_b", F.when(
        cloud.isNotNull(), clamp(truncated(F.round(F.col("_edge") * 0.60 + cloud * 0.40, 6)))).otherwise(F.col("_edge")))
    df = df.withColumn("_b", F.when(F.col("_fraud"), F.greatest(F.col("_b"), F.lit(85))).otherwise(F.col("_b")))
    short = F.exists(urls, shortened_link)
    hard_link = F.exists(urls, lambda u: suspicious_link(u) & ~shortened_link(u))
    df = df.withColumns({
        "_technical": (url >= 0.40) | (struct_s >= 0.70) | (typo >= 0.50) | hard_link | (short & F.col("_corr")),
        "_cloud_ok": F.col("_cloud") >= 60,
        "_url_strong": (url >= 0.60),
    })
    text_only = ~F.col("_fraud") & ~F.col("_technical") & ~F.col("_corr") & ~F.col("_cloud_ok") & ~F.col("_url_strong")
    clean = (
        ~F.col("_technical") & ~F.col("_corr") & ~F.col("_cloud_ok") & ~F.col("_url_strong") & ~F.col("_scam")
        & (url < 0.30) & (F.col("nlp_score") < 0.40) & (struct_s < 0.30) & (typo < 0.40))
    df = df.withColumns({"_text_only": text_only, "_clean": clean & ~F.col("_fraud")})
    df = df.withColumn("_b", F.when(F.col("_text_only"), F.least(F.col("_b"), F.lit(29))).otherwise(F.col("_b")))
    local_sum = url + F.col("nlp_score") + struct_s + typo
    second = ~F.col("_scam") & ~F.col("_corr") & (local_sum < 0.80) & ~F.col("_fraud") & (F.col("_cloud") >= 70)
    cap = lambda hi, lo: F.least(F.col("_b"), F.when(F.col("_reward"), lo).otherwise(hi))
    df = df.withColumn("_b", (
        F.when(F.col("_clean") & (F.col("_cloud") >= 70), F.when(F.col("_reward"), 28).otherwise(38))
        .when(F.col("_clean") & (F.col("_cloud") >= 40), cap(35, 25))
        .when(F.col("_clean"), cap(25, 18))
        .when(second, F.least(F.col("_b"), F.lit(39)))
        .otherwise(F.col("_b"))))
    df = df.withColumn("_b", F.when(
        F.col("_corr") & F.col("_badlink"), F.greatest(F.col("_b"), F.lit(DANGER_MIN))).otherwise(F.col("_b")))
    peak = F.greatest(
        F.col("_upi"), F.col("_u"), F.col("_st"), F.col("_t"), F.col("_cloud"))
    df = df.withColumn("_peak", peak)
    df = df.withColumn("risk_score", (
        F.when(F.col("_peak") >= 85, F.greatest(F.col("_b"), truncated(F.round(F.col("_peak") * 0.9, 6))))
        .when(~F.col("_text_only") & (F.col("_peak") >= 60),
              F.greatest(F.col("_b"), truncated(F.round(F.col("_peak") * 0.75, 6))))
        .otherwise(F.col("_b"))).cast("int"))
    raw = (
        F.when(F.col("_fraud") | (F.col("risk_score") >= DANGER_MIN), "DANGER")
        .when(F.col("risk_score") >= 30, "WARNING").otherwise("SAFE"))
    high = (
        (F.col("_upi") >= 70) | (F.col("_has_urls") & (F.col("_u") >= 70)) | (F.col("_n") >= 70)
        | (F.col("_st") >= 70) | (F.col("_t") >= 70) | (F.col("_cloud") >= 70))
    df = df.withColumn("is_complete", ~((raw == "SAFE") & high))
    df = df.withColumn("verdict", F.when(~F.col("is_complete"), "WARNING").otherwise(raw))
    body, score = F.coalesce(F.col("text"), F.lit("")), F.col("risk_score")
    category = (
        F.when(F.col("_fraud") | (body.rlike(r"(?i)\b(upi|pin|paytm|phonepe|gpay)\b") & (score >= 50)), "OTP_FRAUD")
        .when((url > 0.60) | F.col("_badlink"), "PHISHING")
        .when(body.rlike(r"(?i)\b(otp|pin|aadhaar|pan|bank|cvv)\b") & F.col("_corr") & (score >= WARNING_MIN), "OTP_FRAUD")
        .when(body.rlike(r"(?i)\b(job|salary|internship|hiring|earn daily)\b") & (score >= WARNING_MIN), "FAKE_JOB")
        .when((F.col("_nlp") > 0.50) & (F.col("verdict") != "SAFE"), "SCAM")
        .when(F.col("verdict") != "SAFE", "SUSPICIOUS").otherwise("SAFE"))
    factors = compact(
        F.when(~F.col("is_complete"), F.format_string(
            "ANALYSIS INCOMPLETE: High-risk signals detected (%d%% peak score)", F.col("_peak"))),
        F.when(F.col("_fraud"), F.lit("UPI collect-request disguised as money receipt")),
        F.when(pct(url) >= 40, F.lit("Suspicious URL structure / unverified link")),
        F.when((F.col("_n") >= 40) & F.col("_corr"), F.lit("Corroborated urgency or credentials-seeking language pattern")),
        F.when(F.col("_t") >= 50, F.lit("Domain typosquatting mimicking official brand")),
        F.when(cloud >= 40, F.lit("Cloud AI flagged threat signatures")),
    )
    factors = F.when(F.size(factors) == 0, F.array(F.lit("No high risk anomalies detected"))).otherwise(factors)
    out = df.withColumns({"category": category, "risk_factors": factors})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


# -- files and applications ------------------------------------------------

def file_score(structural: Column, ensemble: Column, hard_trigger: Column) -> Column:
    mixed = truncated(F.round(ensemble * 0.40 + structural * 0.60, 6))
    return F.least(F.lit(100), (
        F.when(hard_trigger, structural)
        .when(ensemble >= FILE_MALICIOUS_MIN, F.greatest(structural, ensemble))
        .otherwise(clamp(F.greatest(structural, mixed))))).cast("int")


def download_score(df: DataFrame) -> DataFrame:
    """Score a download from its metadata; needs ``file_name, declared_size, url_ml_score``."""
    name = F.lower(F.coalesce(F.col("file_name"), F.lit("")))
    double = name.rlike(r"\.[a-z0-9]{2,4}\.(apk|exe|vbs|bat|cmd|js|ps1|scr|jar)$")
    ext = F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("")
    executable = F.concat(F.lit("."), ext).isin(lx.PAYLOAD_EXTENSIONS)
    oversized = name.rlike(r"\.(jpg|png|jpeg)$") & (F.col("declared_size") > 25 * 1024 * 1024)
    meta = clamp(
        F.when(double, 50).otherwise(0) + F.when(executable, 30).otherwise(0) + F.when(oversized, 35).otherwise(0))
    df = df.withColumns({"metadata_score": meta.cast("int"), "_fast": F.coalesce(F.col("url_ml_score"), F.lit(0))})
    blended = clamp(truncated(F.col("metadata_score") * 0.5 + F.col("_fast") * 0.5))
    backed = ((F.col("metadata_score") >= 40) & (F.col("_fast") >= 40)) | (double & (ext == "apk"))
    df = df.withColumn("pre_score", F.when(backed, blended).otherwise(F.least(blended, F.lit(FILE_MALICIOUS_MIN - 1))).cast("int"))
    return df.withColumn("verdict", file_verdict(F.col("pre_score"))).drop("_fast")


def safe_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def safe_bool(c: Column) -> Column:
    """Text, number or NULL as a boolean."""
    lower = F.lower(F.trim(c.cast("string")))
    return (
        F.when(lower.isNull(), False)
        .when(lower.isin("true", "1", "yes", "y", "present", "detected"), True)
        .when(lower.isin("false", "0", "no", "n", "absent", "not_detected"), False)
        .otherwise(lower != "")
    )


def malware_risk(df: DataFrame) -> DataFrame:
    """Aggregate a model result and static evidence.

    Needs ``prediction, score, dangerous_targets, security_stream_urls,
    application_urls, external_urls`` and the flags ``high_entropy,
    network_execution, obfuscation_execution, vba_autoexec, vba_network``.
    """
    prediction = F.coalesce(F.upper(F.trim(F.col("prediction"))), F.lit("UNKNOWN"))
    score = clamp(safe_float(F.col("score")), 0.0, 1.0)
    df = df.withColumns({"model_prediction": prediction, "model_score": score})
    p, s = F.col("model_prediction"), F.col("model_score") * 100.0
    base = (
        F.when(p == "MALICIOUS", F.greatest(s, F.lit(75.0))).when(p == "SUSPICIOUS", F.greatest(s, F.lit(50.0)))
        .when(p == "REQUIRES_EXTRACTION", F.greatest(s, F.lit(35.0)))
        .when(p == "UNSUPPORTED", F.greatest(s, F.lit(20.0))).otherwise(s))
    n = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).cast("int")
    counts = [
        ("dangerous_targets", 30, "OLE contains %d dangerous target URL(s)."),
        ("security_stream_urls", 20, "OLE security-stream URL evidence detected (%d URL(s))."),
        ("application_urls", 25, "OLE contains .application URL evidence (%d URL(s))."),
        ("external_urls", 10, "External non-standard URL evidence detected (%d URL(s))."),
    ]
    flags = [
        ("high_entropy", 10, "High-entropy content indicator detected."),
        ("network_execution", 20, "Network activity and execution indicators occur together."),
        ("obfuscation_execution", 20, "Obfuscation and execution indicators occur together."),
        ("vba_autoexec", 25, "VBA and automatic execution indicators occur together."),
        ("vba_network", 20, "VBA and network indicators occur together."),
    ]
    points = base
    reasons = [
        F.when(p == "MALICIOUS", F.lit("Specialized malware model classified the file as MALICIOUS."))
        .when(p.isin("BENIGN", "SAFE"), F.lit("Specialized malware model classified the file as BENIGN."))
        .when(p == "SUSPICIOUS", F.lit("Specialized malware model classified the file as SUSPICIOUS."))
        .when(p == "REQUIRES_EXTRACTION", F.lit("File requires controlled extraction before complete content analysis."))
        .when(p == "UNSUPPORTED", F.lit("File type is currently unsupported."))
        .otherwise(F.concat(F.lit("Underlying model returned prediction: "), p, F.lit(".")))]
    for name, weight, reason in counts:
        points = points + F.when(n(name) > 0, float(weight)).otherwise(0.0)
        reasons.append(F.when(n(name) > 0, F.format_string(reason, n(name))))
    for name, weight, reason in flags:
        points = points + F.when(safe_bool(F.col(name)), float(weight)).otherwise(0.0)
        reasons.append(F.when(safe_bool(F.col(name)), F.lit(reason)))
    df = df.withColumns({"risk_score": F.round(clamp(points, 0.0, 100.0), 2), "reasons": compact(*reasons)})
    risk = F.col("risk_score")
    verdict = (
        F.when((p == "MALICIOUS") | (risk >= 80), "MALICIOUS")
        .when(p.isin("SUSPICIOUS", "REQUIRES_EXTRACTION", "UNSUPPORTED") | (risk >= 40), "SUSPICIOUS")
        .otherwise("SAFE"))
    df = df.withColumn("final_verdict", verdict)
    v = F.col("final_verdict")
    confidence = (
        F.when(p == "MALICIOUS", F.when(F.col("model_score") >= 0.80, "HIGH").otherwise("MEDIUM"))
        .when(p.isin("BENIGN", "SAFE") & (v == "SAFE") & (F.col("model_score") <= 0.30), "HIGH")
        .when(v == "MALICIOUS", "HIGH").otherwise("MEDIUM"))
    return df.withColumn("confidence", confidence)


# -- small numeric rules ---------------------------------------------------

def soft_vote(first: Column, second: Column) -> Column:
    return first * 0.60 + second * 0.40


def soft_vote_flag(score: Column) -> Column:
    return score >= 0.72


def two_class_softmax(benign: Column, threat: Column) -> Column:
    """Probability of the second logit, shifted by the larger one."""
    top = F.greatest(benign, threat)
    a, b = F.exp(benign - top), F.exp(threat - top)
    return b / (a + b)


def to_probability(raw: Column) -> Column:
    """Pass 0..1 through, squash logits, read NaN as zero."""
    return (
        F.when(raw.isNull() | F.isnan(raw), 0.0).when(raw.between(0.0, 1.0), raw)
        .otherwise(1.0 / (1.0 + F.exp(-raw))))


def calibrate(score: Column, knots: tuple[list[float], list[float]]) -> Column:
    """Piecewise-linear isotonic lookup, constant beyond the ends."""
    xs, ys = knots
    chain = F.when(score <= xs[0], ys[0])
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        slope = (y1 - y0) / (x1 - x0) if x1 > x0 else 0.0
        chain = chain.when(score <= x1, F.lit(y0) + (score - x0) * slope)
    return chain.otherwise(ys[-1])


def verdict_bands(verdict: Column) -> Column:
    """Three-level verdict in the four-band scheme."""
    chain = None
    for level, band, _ in lx.VERDICT_MAP:
        chain = F.when(verdict == level, band) if chain is None else chain.when(verdict == level, band)
    return chain.otherwise("SAFE")


def representative_score(verdict: Column) -> Column:
    return F.when(verdict == "WARNING", 55).when(verdict == "DANGER", 85).otherwise(10)


# -- adaptive weights ------------------------------------------------------

_N = len(lx.COMPONENTS)


def weight_step(weights, scores, verdict: str, correct: bool):
    """One feedback event on a weight vector (numpy; used by batch and stream folds)."""
    import numpy as np

    w, s = np.asarray(weights, dtype="float64").copy(), np.asarray(scores, dtype="float64")
    alarm = verdict in ("DANGER", "WARNING")
    # A miss blames the quietest models, everything else looks at the loudest ones.
    blame_quiet = not correct and not alarm
    target = s <= s.min() + 0.05 if blame_quiet else s >= s.max() - 0.05
    step = lx.STEP_CORRECT if correct else (-lx.STEP_WRONG if alarm else lx.STEP_WRONG)
    if not correct or alarm:
        w[target] += step
        rest = ~target
        if rest.any():
            w[rest] -= step * target.sum() / rest.sum()
    for _ in range(5):
        w = np.where(np.isfinite(w) & (w >= 0), np.clip(w, lx.MIN_WEIGHT, lx.MAX_WEIGHT), lx.MIN_WEIGHT)
        w = w / w.sum()
    return w
