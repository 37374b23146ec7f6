"""Case history as an incremental index, so a micro-batch meets only what shares its values.

Every batch writes folders of its own: ``pairs`` (value, case), ``values`` (per value the number of its new cases and the
first of them), both cut into buckets by a hash of the value, ``cases`` (bucketed by case) and at last a line in ``log``.
A later batch reads only buckets that its own values fall in, and only batches that the log names before it; so a batch
that is repeated sees what it saw and overwrites what it wrote. ``compact`` folds logged batches into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators.cases import upsert
from riskframe.operators.correlation import explain_relation, linkable, relation_of
from riskframe.operators.joins import lookup_join

_CASE = "case_id string, ts timestamp, sender string, verdict string, risk_score int, primary_category string"
_LOG = "batch_id long, since long, buckets int"


class CaseHistory:
    """The index below ``path``. ``shown``: how many other cases of a value are kept by name; counts are exact."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, shown: int = 10) -> None:
        self.spark, self.path, self.buckets, self.shown = spark, path.rstrip("/"), buckets, shown
        first = f"array<struct<case_id:string,verdict:string>>"
        self.schemas = {
            "pairs": "normalized_value string, case_id string", "cases": _CASE,
            "values": f"normalized_value string, case_count long, first_cases {first}"}
        spark.createDataFrame([], _LOG).write.mode("append").parquet(f"{self.path}/log")
        for name, schema in self.schemas.items():
            spark.createDataFrame([], f"{schema}, batch_id long, bucket int").write.mode("append").partitionBy("batch_id", "bucket").parquet(f"{self.path}/{name}")

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def batches(self, before: int) -> list[int]:
        """Logged batches to read for a batch: the last compacted one, and those after it. One line of the log a batch."""
        lines = sorted((r["batch_id"], r["since"]) for r in self.spark.read.schema(_LOG).parquet(f"{self.path}/log").collect())
        lines = [x for x in lines if x[0] < before]
        folded = max((k for k, since in lines if since < k), default=-1)
        return sorted({k for k, _ in lines if k >= folded})

    def read(self, name: str, before: int, touched: list[int] | None = None) -> DataFrame:
        """What batches before ``before`` wrote, in the touched buckets only (all if None)."""
        df = self.spark.read.schema(f"{self.schemas[name]}, batch_id long, bucket int").parquet(f"{self.path}/{name}")
        df = df.filter(F.col("batch_id").isin(self.batches(before)))
        return df if touched is None else df.filter(F.col("bucket").isin(touched))

    def _write(self, name: str, df: DataFrame, key: str, batch: int) -> DataFrame:
        """A folder of the batch, written anew if it is there, and read back."""
        folder = f"{self.path}/{name}/batch_id={batch}"
        df.withColumn("bucket", self.bucket(F.col(key))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        return self.spark.read.schema(f"{self.schemas[name]}, bucket int").parquet(folder)

    def add(self, cases: DataFrame, indicators: DataFrame, batch: int) -> DataFrame:
        """Take a batch in and return its links to earlier cases and among its own.

        ``cases``: case_id, ts, sender, verdict, risk_score, primary_category; ``indicators``: case_id, indicator_type,
        indicator_value, normalized_value. A case that comes again replaces its row and is not counted twice.
        """
        merged = cases.groupBy("case_id").agg(F.max_by(F.struct(*[c for c in cases.columns if c != "case_id"]), F.struct("ts", "verdict")).alias("r")).select("case_id", "r.*")
        own_cases = self._write("cases", merged.select(*_names(_CASE)), "case_id", batch)
        usable = linkable(indicators).select("case_id", "indicator_type", "indicator_value", "normalized_value").distinct()
        touched_cases = [r["bucket"] for r in own_cases.select("bucket").distinct().collect()]  # at most ``buckets``
        again = self.read("cases", batch, touched_cases).select("case_id").join(own_cases.select("case_id"), "case_id", "left_semi").distinct()
        members = usable.select("normalized_value", "case_id").distinct().withColumn("_b", self.bucket(F.col("normalized_value")))
        touched = [r["_b"] for r in members.select("_b").distinct().collect()]
        # Only cases that came before can hold a value already.
        known = self.read("pairs", batch, touched).join(again, "case_id", "left_semi").select("normalized_value", "case_id").distinct()
        pairs = self._write("pairs", members.drop("_b").join(known, ["normalized_value", "case_id"], "left_anti"), "normalized_value", batch)
        named = pairs.join(own_cases.select("case_id", "verdict"), "case_id", "left")
        fresh = self._write("values", self._summed(named), "normalized_value", batch).drop("bucket")
        past = self.read("values", batch, touched).drop("bucket", "batch_id")
        wanted = usable.select("normalized_value").distinct()
        now = self._folded(fresh.unionByName(past.join(wanted, "normalized_value", "left_semi")))
        joined = lookup_join(usable, now.filter("case_count > 1"), "normalized_value", "inner")
        others = F.slice(F.filter("first_cases", lambda o: o["case_id"] != F.col("case_id")), 1, self.shown)
        relation, confidence = relation_of(F.col("indicator_type"))
        links = joined.withColumn("_o", F.explode(others)).select(
            "case_id", "indicator_type", "indicator_value", "normalized_value", F.col("_o.case_id").alias("target_case_id"),
            F.coalesce("_o.verdict", F.lit("UNKNOWN")).alias("target_verdict"), F.col("case_count").alias("value_case_count"))
        return links.withColumns({"relationship_type": relation, "confidence": confidence, "explanation": explain_relation(
            F.col("indicator_type"), F.col("indicator_value"), F.col("normalized_value"), F.col("target_case_id"))})

    def commit(self, batch: int, since: int | None = None) -> None:
        """Name the batch in the log; a repeated one is named again in its own file."""
        line = self.spark.range(1).select(F.lit(batch).cast("long").alias("batch_id"), F.lit(batch if since is None else since).cast("long").alias("since"),
                                          F.lit(self.buckets).alias("buckets"))
        line.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/line={batch}")

    def _summed(self, named: DataFrame) -> DataFrame:
        """Per value the number of cases and the first ``shown + 1`` of them; ranked heads, never a whole value in a list."""
        from riskframe.operators.joins import top_n

        heads = top_n(named, ["normalized_value"], [F.col("case_id")], self.shown + 1)
        heads = heads.groupBy("normalized_value").agg(F.array_sort(F.collect_list(F.struct("case_id", "verdict"))).alias("first_cases"))
        return named.groupBy("normalized_value").agg(F.count(F.lit(1)).alias("case_count")).join(heads, "normalized_value")

    def _folded(self, summaries: DataFrame) -> DataFrame:
        """One summary a value; a value has at most one of each batch since the last compaction."""
        heads = F.slice(F.array_sort(F.flatten(F.collect_list("first_cases"))), 1, self.shown + 1)
        return summaries.groupBy("normalized_value").agg(F.sum("case_count").alias("case_count"), heads.alias("first_cases"))

    def cases(self, before: int = 1 << 62) -> DataFrame:
        """The newest row of each case."""
        rows = self.read("cases", before).withColumnRenamed("batch_id", "version").drop("bucket")
        return upsert(rows.limit(0), rows, ["case_id"], "version").drop("version")

    def values(self, before: int = 1 << 62) -> DataFrame:
        return self._folded(self.read("values", before).drop("bucket", "batch_id"))

    def compact(self, upto: int) -> None:
        """Fold all logged batches up to ``upto`` into the folder of that batch. Run it between batches.

        The folded tables are written aside and then stand in for the batch; readers find the old files or the new ones by
        the log's line, which is replaced last.
        """
        folded = {
            "values": (self._folded(self.read("values", upto + 1).drop("bucket", "batch_id")), "normalized_value"),
            "pairs": (self.read("pairs", upto + 1).select("normalized_value", "case_id").distinct(), "normalized_value"),
            "cases": (self.cases(upto + 1), "case_id")}
        staged = {}
        for name, (df, key) in folded.items():
            aside = f"{self.path}/folded/{name}-{upto}"
            df.write.mode("overwrite").parquet(aside)
            staged[name] = (self.spark.read.schema(self.schemas[name]).parquet(aside), key)
        for name, (df, key) in staged.items():
            self._write(name, df, key, upto)
        self.commit(upto, since=min(self.batches(upto + 1), default=upto) if self.batches(upto + 1) != [upto] else upto - 1)


def _names(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(",")]
