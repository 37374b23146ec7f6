"""Tabular sources: labelled text, raw features, word lists, schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe import lexicons as lx
from riskframe.schemas import LABELLED_TEXT, RAW_FEATURES


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled text; a file without the two columns is refused before anything runs."""
    header = spark.read.option("header", True).csv(path).columns
    missing = {"text", "label"} - set(header)
    if missing:
        raise ValueError(f"input CSV lacks columns: {sorted(missing)}")
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(LABELLED_TEXT).fields])


def read_raw_features(spark: SparkSession, paths: list[str], schema: str = RAW_FEATURES) -> DataFrame:
    return spark.read.schema(schema).json(paths)


def build_metadata(train: DataFrame, test: DataFrame) -> DataFrame:
    """Metadata columns of both subsets in one table, tagged by subset."""
    keys = ["sha256", "appeared", "label", "avclass"]
    pick = lambda df, tag: df.select(*[c for c in keys if c in df.columns], F.lit(tag).alias("subset"))
    return pick(train, "train").unionByName(pick(test, "test"), allowMissingColumns=True)


def labelled(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(F.col(label) != -1)


def load_dims(spark: SparkSession) -> dict[str, DataFrame]:
    """The fixed word and brand lists as small tables."""
    rows = lambda data, ddl: spark.createDataFrame(data, ddl)
    return {
        "phrase": rows([(k, i, p) for k, ps in lx.PHRASE_LISTS.items() for i, p in enumerate(ps)], "list_name string, ordinal int, phrase string"),
        "tld": rows([(t,) for t in lx.SUSPICIOUS_TLDS], "tld string"),
        "shortener": rows([(s,) for s in lx.SHORTENERS], "domain string"),
        "trusted": rows([(d,) for d in lx.TRUSTED_DOMAINS], "domain string"),
        "brand": rows([(i, b, d) for i, (b, d) in enumerate(lx.PROTECTED_BRANDS)], "ordinal int, brand string, domains array<string>"),
        "model": rows(lx.MODEL_MANIFEST, "model_id string, status string, weight double"),
        "certificate": rows(lx.BANK_CERTIFICATES, "package string, expected_sha256 string"),
        "explanation": rows(lx.AUTH_EXPLANATIONS, "protocol string, status string, explanation string"),
        "allowlist": rows([(d,) for d in lx.ALLOWLISTED_DOMAINS], "domain string"),
    }


def evolve(df: DataFrame, schema: str, defaults: dict | None = None) -> DataFrame:
    """Bring an older table to the current schema: missing columns get their default."""
    defaults = defaults or {}
    out = []
    for field in T.StructType.fromDDL(schema).fields:
        value = F.col(field.name).cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]).cast(field.dataType))
        out.append(value.alias(field.name))
    return df.select(*out)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Model manifest JSON (one document with a list of models)."""
    schema = "models array<struct<model_id:string,status:string,weight:double>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.inline("models"))
