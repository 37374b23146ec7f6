"""Table and file outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fixed columns of the scan export, with their source columns.
EXPORT_COLUMNS = [
    ("id", "id"), ("timestamp", "ts"), ("app_source", "app_source"), ("sender", "sender"), ("subject", "subject"),
    ("verdict", "verdict"), ("risk_score", "risk_score"), ("category", "category"), ("trust", "sender_trust"),
    ("summary", "summary"), ("red_flags", "flags"), ("action", "action"), ("ml_score", "ml_score"),
    ("ai_score", "ai_score"), ("snippet", "snippet"), ("flagged_urls", "flagged_urls"),
]


def export_frame(scans: DataFrame) -> DataFrame:
    """The 16 export columns; missing sources are NULL, flags are joined with ``; ``."""
    out = []
    for name, source in EXPORT_COLUMNS:
        if source not in scans.columns:
            value = F.lit(None).cast("string")
        elif source == "ts":
            value = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
        elif source == "flags":
            value = F.array_join("flags", "; ")
        else:
            value = F.col(source)
        out.append(value.alias(name))
    return scans.select(*out)


def export_scans(scans: DataFrame, path: str, export_date: str) -> None:
    """Write the export as CSV under the export date."""
    export_frame(scans).withColumn("export_date", F.lit(export_date)).write.mode("append").partitionBy(
        "export_date").option("header", True).csv(path)


def pack_region_scans(df: DataFrame) -> DataFrame:
    """Region scans with the lists packed into text."""
    return df.withColumns({"extracted_urls": F.array_join("urls", ","), "recommended_actions": F.array_join("actions", "|")}).drop("urls", "actions")


def unpack_region_scans(df: DataFrame) -> DataFrame:
    split = lambda c, sep: F.filter(F.split(c, sep), lambda x: x != "")
    return df.withColumns({"urls": split(F.col("extracted_urls"), ","), "actions": split(F.col("recommended_actions"), r"\|")}).drop(
        "extracted_urls", "recommended_actions")


def replace_table(df: DataFrame, path: str) -> None:
    """Publish a rewritten table under a new version folder; readers follow ``_current``."""
    from uuid import uuid4

    version = f"{path}/v-{uuid4().hex}"
    df.write.mode("error").parquet(version)
    spark = df.sparkSession
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/_current")


def read_current(spark, path: str) -> DataFrame:
    version = spark.read.schema("version string").json(f"{path}/_current").first()["version"]
    return spark.read.parquet(version)
