"""Streaming forms of the operators and the runner for landed data."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe import lexicons as lx
from riskframe.session import STREAM_CONF, shared_root
from riskframe.streaming.processors import (
    BUFFER_OUTPUT, CLAIM_OUTPUT, INTENT_OUTPUT, WEIGHT_OUTPUT, Claims, Cooldown, IntentMatch, RecentBuffer, WeightAdapter, run_processor,
)

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def prepare(spark: SparkSession) -> SparkSession:
    """State store settings of the stateful operators."""
    for key, value in STREAM_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the cluster's checkpoint folder (a local one only where none is named)."""
    return f"{shared_root(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


class Heartbeat:
    """A side input that moves the watermark while the sources are silent, or past the end of landed data.

    Its rows have only a time. ``with_watermark`` unites it with a stream below one watermark; operators never let its rows
    out, as their windows stay open and their keys are NULL.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = prepare(spark), folder or f"{shared_folder(spark)}/heartbeat"
        spark.createDataFrame([], "at timestamp").write.mode("append").parquet(self.folder)

    def beat(self, at: str) -> None:
        self.spark.sql("SELECT CAST(:at AS TIMESTAMP) AS at", {"at": at}).write.mode("append").parquet(self.folder)

    def with_watermark(self, stream: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
        beats = self.spark.readStream.schema("at timestamp").parquet(self.folder)
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields if f.name != ts]
        return stream.unionByName(beats.select(F.col("at").alias(ts), *rest)).withWatermark(ts, delay)


#: A moment after which no window of the data is open.
END_OF_TIME = "9999-01-01 00:00:00"


def read_events(spark: SparkSession, sf_dir: str, watermark: str = "10 minutes", heartbeat: Heartbeat | None = None) -> DataFrame:
    """The events table as a stream; the naive time column becomes a UTC timestamp."""
    raw = prepare(spark).readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    raw = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    return heartbeat.with_watermark(raw, "ts", watermark) if heartbeat else raw.withWatermark("ts", watermark)


def run_available(stream: DataFrame, mode: str = "append", heartbeat: Heartbeat | None = None) -> DataFrame:
    """Process everything available and return the sink table.

    Append mode writes the fault-tolerant file sink; the other modes keep the
    last version of each batch under its batch id. With a heartbeat the query
    runs once more after the end of the data, so that every window closes.
    """
    folder = shared_folder(stream.sparkSession)
    out, state = f"{folder}/out", f"{folder}/checkpoint"

    def run() -> None:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
        if mode == "append":
            query = writer.format("parquet").option("path", out).start()
        else:
            query = writer.foreachBatch(lambda df, batch: write_batch(df, batch, out)).start()
        query.awaitTermination()

    run()
    if heartbeat:
        heartbeat.beat(END_OF_TIME)
        run()
    return stream.sparkSession.read.schema(stream.schema if mode == "append" else _with_batch(stream.schema)).parquet(out)


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


def write_batch(df: DataFrame, batch: int, path: str) -> None:
    """Idempotent write: a repeated batch replaces its own folder."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


# -- operators -------------------------------------------------------------

def cooldown(df: DataFrame, keys: list[str], seconds: float, ts: str = "ts", row_id: str = "id",
             content: str | None = None, buckets: int = 1024) -> DataFrame:
    """Exact cooldown per key (alerts, analysis lock, content digests).

    State costs some calls a group and batch, too many where most keys have one row. So the keys, told apart by a digest
    (SHA-256), share ``buckets`` groups, and a micro-batch rewrites the live keys of the groups it touches. The number is part
    of a running query's state: choose it for the keys that are live at once and keep it.
    """
    digest = F.unhex(F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256))
    helpers = ("key_digest", "key_bucket")  # a frame's columns lose names that begin with an underscore
    dealt = df.withColumn(helpers[0], digest).withColumn(helpers[1], F.pmod(F.xxhash64(helpers[0]), F.lit(buckets)))
    return run_processor(dealt, [helpers[1]], Cooldown(seconds, ts, row_id, content, helpers[0], helpers), _without_metadata(df.schema))


def _without_metadata(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable) for f in schema.fields])


def suppress_repeats(df: DataFrame, keys: list[str], content: str, seconds: float = 300) -> DataFrame:
    """Drop events that repeat the last accepted content within the interval."""
    return cooldown(df, keys, seconds, content=content)


def dedup_exact(df: DataFrame, keys: list[str], seconds: float = 60) -> DataFrame:
    """Drop events whose key was accepted less than ``seconds`` before."""
    return cooldown(df, keys, seconds)


def debounce(df: DataFrame, keys: list[str], gap: str = "1 second", ts: str = "ts", value: str = "content") -> DataFrame:
    """Only the last event of each burst."""
    grouped = df.groupBy(F.session_window(ts, gap).alias("burst"), *keys)
    return grouped.agg(F.max_by(value, ts).alias(value), F.count(F.lit(1)).alias("n_events")).select(
        *keys, F.col("burst.start").alias("burst_start"), F.col("burst.end").alias("burst_end"), value, "n_events")


def daily_counts(df: DataFrame, verdict: Column, ts: str = "ts") -> DataFrame:
    """Tumbling day counts by verdict."""
    out = df.groupBy(F.window(ts, "1 day").alias("w"), verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("day"), "verdict", "n")


def intent_rows(files: DataFrame, intents: DataFrame) -> DataFrame:
    """Files and intents as one table for ``match_intents``.

    ``files``: tenant, file_id, path, ts; ``intents``: tenant, intent_id, package, intent_type, ts. Packages that one path
    may ask for share a group, so a file and all intents it may use meet under one key.
    """
    from riskframe.operators.history import candidate_packages

    group = F.lit(None).cast("string")
    for _, packages in lx.PATH_PACKAGES:
        group = F.when(F.col("package").isin(packages), packages[0]).otherwise(group)
    asked = files.select("tenant", "ts", F.lit(True).alias("is_file"), F.col("file_id").alias("row_id"), F.lit(None).cast("string").alias("package"),
                         candidate_packages(F.col("path")).alias("packages"), F.lit(None).cast("string").alias("intent_type"))
    primed = intents.select("tenant", "ts", F.lit(False).alias("is_file"), F.col("intent_id").alias("row_id"), "package",
                            F.lit(None).cast("array<string>").alias("packages"), "intent_type")
    first = F.coalesce(F.get("packages", F.lit(0)), group)
    return asked.withColumn("group", F.get("packages", F.lit(0))).unionByName(primed.withColumn("group", group)).withColumn("group", first)


def match_intents(rows: DataFrame, seconds: float = 15) -> DataFrame:
    """Each file with the intent it uses up, or alone; both come out when the watermark has passed the file.

    ``rows``: ``intent_rows`` under a watermark on ``ts``. Files whose path names no package need no state. The filter before
    the state names ``ts``, as Spark moves one that does not below the watermark, which then misses a heartbeat's rows.
    """
    keyed = rows.filter(F.col("group").isNotNull() | F.col("ts").isNull())
    matched = run_processor(keyed, ["tenant", "group"], IntentMatch(seconds), INTENT_OUTPUT)
    alone = rows.filter(F.col("group").isNull() & F.col("is_file")).select(
        "tenant", F.col("row_id").alias("file_id"), F.col("ts").alias("file_ts"), F.lit(None).cast("long").alias("intent_id"),
        F.lit(None).cast("string").alias("package"), F.lit(None).cast("string").alias("intent_type"), F.lit(None).cast("timestamp").alias("intent_ts"))
    return matched.unionByName(alone)


def claims(df: DataFrame, seconds: float = 10) -> DataFrame:
    return run_processor(df, ["uri"], Claims(seconds), CLAIM_OUTPUT)


def adapt_weights(df: DataFrame) -> DataFrame:
    """Online weights per tenant; emits the new vector after each batch."""
    return run_processor(df, ["tenant"], WeightAdapter(), WEIGHT_OUTPUT, "update", "None")


def recent_buffer(df: DataFrame, size: int = 500) -> DataFrame:
    return run_processor(df, ["tenant"], RecentBuffer(size), BUFFER_OUTPUT, "update", "None")


def cached_lookup(stream: DataFrame, dim: DataFrame, key: str, ts: str = "ts", fetched: str = "fetched_at",
                  ttl_seconds: int = 600) -> DataFrame:
    """Reuse a looked-up value while it is fresh at the time of the event.

    A key may have been looked up several times; an event takes the newest version at or before it, and stays one event.
    """
    values = [c for c in dim.columns if c not in (key, fetched)]
    versions = dim.groupBy(key).agg(F.collect_list(F.struct(F.col(fetched).alias("_at"), *values)).alias("_versions"))
    joined = stream.join(versions, key, "left")
    known = F.sort_array(F.filter("_versions", lambda v: v["_at"] <= F.col(ts)), asc=False)
    joined = joined.withColumn("_v", F.get(known, F.lit(0))).drop("_versions")
    fresh = F.unix_micros(F.col(ts)) - F.unix_micros("_v._at") <= ttl_seconds * 1_000_000
    return joined.withColumns({c: F.when(fresh, F.col(f"_v.{c}")) for c in values}).drop("_v")


def overlay_alerts(foreground: DataFrame, overlays: DataFrame, seconds: float = 30) -> DataFrame:
    """Banking app in front while a foreign overlay is active, at most once per interval and app.

    ``foreground``: device_id, package, label, ts, id; ``overlays``: device_id,
    overlay_package, active_from, active_to (static).
    """
    from riskframe.operators.apps import claims_bank

    banking = foreground.filter(claims_bank(F.coalesce("label", F.lit("")), F.col("package")))
    joined = banking.join(overlays, "device_id").filter(
        (F.col("ts") >= F.col("active_from")) & (F.col("ts") <= F.coalesce("active_to", F.col("ts"))))
    return cooldown(joined, ["device_id", "package"], seconds)


def message_indicators(messages: DataFrame) -> DataFrame:
    """Indicators of messages: sender, its domain, origin address, hosts of links, attachment digests.

    ``received_headers``, ``raw_headers`` and ``attachment_hashes`` are used where the table has them.
    """
    from riskframe.functions.text import extract_urls
    from riskframe.functions.urls import host_of
    from riskframe.operators.correlation import index_indicators
    from riskframe.operators.enrichment import hop_array, origin_ip

    have = set(messages.columns)
    empty = F.array().cast("array<string>")
    received = F.col("received_headers") if "received_headers" in have else empty
    origin = origin_ip(hop_array(received), received, F.col("raw_headers"))["ip"] if "raw_headers" in have else F.lit(None).cast("string")
    cases = messages.select(
        F.col("email_id").cast("string").alias("case_id"), (F.col("ts") if "ts" in have else F.lit(None).cast("timestamp")).alias("ts"), "sender",
        origin.alias("origin_ip"), F.array_distinct(F.transform(extract_urls("body_text"), host_of)).alias("url_domains"),
        (F.col("attachment_hashes") if "attachment_hashes" in have else empty).alias("attachment_hashes"))
    return index_indicators(cases)


def triage_batches(messages: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Continuous triage: verdicts, indicators, links to the history and among the batch, and the case upsert.

    Every output goes to a folder of its batch, so a repeated batch overwrites itself; the history below ``path/history``
    grows by what the batch adds (``CaseHistory``). Returns the started query.
    """
    from riskframe.operators.triage import triage
    from riskframe.streaming.history import CaseHistory

    history = CaseHistory(messages.sparkSession, f"{path}/history", buckets)
    shown = ["email_id", "verdict", "risk_score", "primary_category", "summary"]

    def handle(df: DataFrame, batch: int) -> None:
        verdicts = triage(df).select(*shown, "sender", (F.col("ts") if "ts" in df.columns else F.lit(None).cast("timestamp")).alias("ts"))
        verdicts = _written(verdicts, batch, f"{path}/verdicts")
        indicators = _written(message_indicators(df), batch, f"{path}/indicators")
        cases = verdicts.select(F.col("email_id").cast("string").alias("case_id"), "ts", "sender", "verdict", "risk_score", "primary_category")
        write_batch(history.add(cases, indicators, batch), batch, f"{path}/links")
        history.commit(batch)

    return messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _written(df: DataFrame, batch: int, path: str) -> DataFrame:
    """Write a batch's table and go on with what was written."""
    write_batch(df, batch, path)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch_id={batch}")
