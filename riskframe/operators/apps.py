"""Installed-application checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.functions.common import clamp, compact, contains_any

_P = lx.PERMISSION_PREFIX


def claims_bank(label: Column, package: Column) -> Column:
    return contains_any(F.lower(label), lx.BANK_KEYWORDS) | contains_any(F.lower(package), lx.BANK_KEYWORDS)


def certificate_status(apps: DataFrame) -> DataFrame:
    """Compare signing digests with the pinned ones; a missing pin never counts against an app."""
    pins = apps.sparkSession.createDataFrame(lx.BANK_CERTIFICATES, "package string, _expected string")
    out = apps.join(F.broadcast(pins), "package", "left")
    same = F.upper(F.col("_expected")) == F.upper(F.col("cert_sha256"))
    return out.withColumn("cert_status", F.when(
        F.col("_expected").isNull() | F.col("cert_sha256").isNull(), "UNVERIFIED_MISSING_HASH").when(
        same, "MATCH_VERIFIED").otherwise("MISMATCH_SUSPICIOUS")).drop("_expected")


def app_risk(apps: DataFrame, own_package: str | None = None) -> DataFrame:
    """Risk row per installed app, highest first.

    Needs ``package, label, installer, permissions, accessibility_active,
    cert_sha256, system`` (system apps without updates are skipped).
    """
    df = certificate_status(apps.filter(~F.coalesce("system", F.lit(False))))
    if own_package:
        df = df.filter(F.col("package") != own_package)
    has = lambda p: F.array_contains("permissions", _P + p)
    active = F.coalesce("accessibility_active", F.lit(False))
    found = compact(
        F.when(has("RECEIVE_SMS"), F.lit("RECEIVE_SMS")), F.when(has("READ_SMS"), F.lit("READ_SMS")),
        F.when(has("SYSTEM_ALERT_WINDOW"), F.lit("SYSTEM_ALERT_WINDOW")),
        F.when(active, F.lit("ACCESSIBILITY_SERVICE_ENABLED")).when(
            has("BIND_ACCESSIBILITY_SERVICE"), F.lit("ACCESSIBILITY_SERVICE_DECLARED")))
    df = df.withColumns({
        "is_bank": claims_bank(F.coalesce("label", "package"), F.col("package")),
        "is_sideloaded": ~F.coalesce(F.col("installer").isin(lx.STORE_INSTALLERS), F.lit(False)),
        "is_allowlisted": F.col("package").isin(lx.APP_ALLOWLIST), "dangerous_permissions": found})
    n, bank, side = F.size("dangerous_permissions"), F.col("is_bank"), F.col("is_sideloaded")
    df = df.filter((n > 0) | side | bank)
    base = F.when(n >= 4, 85).when(n == 3, 65).when(n == 2, 45).when(n == 1, 20).otherwise(0)
    base = F.when(F.col("cert_status") == "MISMATCH_SUSPICIOUS", 100).when(bank & side, 95).otherwise(base)
    score = clamp(
        base + F.when(active, 15).otherwise(0) + F.when(side & ~bank, 15).otherwise(0)
        - F.when(F.col("is_allowlisted") & ~side, 30).otherwise(0)).cast("int")
    source = F.coalesce("installer", F.lit("APK Sideload"))
    factors = compact(
        F.when(bank & side, F.concat(
            F.lit("CRITICAL: App claims banking/UPI identity ('"), "label", F.lit("') but was sideloaded outside Play Store (Source: "), source, F.lit(")")))
        .when(bank, F.lit("Identified as banking/UPI financial service app")),
        F.when(F.col("cert_status") == "MISMATCH_SUSPICIOUS",
               F.lit("CRITICAL: Certificate SHA-256 signature mismatch against official bank signing key!")),
        F.when(active, F.lit("Accessibility Service is ACTIVELY ENABLED by user in Settings"))
        .when(has("BIND_ACCESSIBILITY_SERVICE"), F.lit("Declares Accessibility Service in manifest (not currently enabled)")),
        F.when(n >= 3, F.format_string("Requests dangerous OTP + Overlay + Accessibility permission combo (%d/4)", n))
        .when(n > 0, F.format_string("Holds partial SMS/Overlay trojan permissions (%d/4)", n)),
        F.when(side & ~bank, F.concat(F.lit("App installed outside Google Play Store (Source: "),
                                      F.coalesce("installer", F.lit("Unknown/APK Sideload")), F.lit(")"))),
        F.when(F.col("is_allowlisted") & ~side, F.concat(F.lit("Verified legitimate utility allowlist entry ("), "label", F.lit(")"))))
    df = df.withColumns({"combo_count": n, "risk_score": score, "risk_factors": factors})
    s = F.col("risk_score")
    level = F.when(s >= 80, "CRITICAL").when(s >= 60, "HIGH").when(s >= 40, "MEDIUM").otherwise("SAFE")
    df = df.withColumn("risk_level", level).withColumn(
        "should_alert", F.col("risk_level").isin("HIGH", "CRITICAL") & ~F.col("is_allowlisted"))
    return df.filter((F.col("risk_level") != "SAFE") | F.col("is_bank")).orderBy(F.desc("risk_score"), "package")
