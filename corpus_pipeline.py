"""A training corpus from raw documents: toxicity, line de-duplication, near-duplicates, mixing, packing.

``STAGES`` holds (name, function); every function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the documents of the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import common as c
from riskframe.llm import lines, minhash, mixing, packing, toxicity
from riskframe.llm.seekable import shared_folder
from riskframe.session import configure


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where the table has that column."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    configure(spark)
    model = toxicity.fit(docs, c.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another document with a smaller id holds go; a document whose lines all went stays, empty."""
    configure(spark)
    return _counted(lines.dedup_lines(docs)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest id stays.

    Documents without a word, and those without an id, are in no group and stay. An id that several rows share stays
    if one of its rows does, and of its equal rows one.
    """
    configure(spark)
    found = minhash.near_duplicates(docs, size=5, least_percent=80).filter("doc_id is not null")
    ids = c.checkpointed(found.groupBy("doc_id").agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows")).filter("_kept"))
    single = docs.join(ids.filter("_rows = 1").select("doc_id"), "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
    shared = docs.join(ids.filter("_rows > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(shared).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: twice, once or not at all."""
    configure(spark)
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences; copies of a document have different ``row``."""
    configure(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A learned classifier and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written to the shared folder and read again."""
    docs = c.table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
