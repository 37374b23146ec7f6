"""Scan history: dashboards, reputation, feedback, downloads and intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.functions.common import any_of, text
from riskframe.operators.joins import top_n
from riskframe.operators.ordered import last_before, previous_values, running_sums, spaced_out


# -- filters ---------------------------------------------------------------

def filter_history(df: DataFrame, verdict: str | None = None, query: str | None = None) -> DataFrame:
    out = df if verdict is None else df.filter(F.col("verdict") == verdict)
    term = (query or "").strip().lower()
    if term:
        out = out.filter(any_of(F.lower(text(c)).contains(term) for c in ("sender", "snippet", "subject")))
    return out


def scrub_category(df: DataFrame, patterns: list[str]) -> DataFrame:
    """Blank stale category labels (SQL ``LIKE`` patterns)."""
    stale = any_of(F.col("category").like(p) for p in patterns)
    return df.withColumn("category", F.when(stale, "").otherwise(F.col("category")))


def apply_feedback(df: DataFrame, feedback: DataFrame, key: str = "id") -> DataFrame:
    """Mark scans as reviewed with the given feedback (one row per id)."""
    given = feedback.select(key, F.col("feedback").alias("_f"))
    return df.join(given, key, "left").withColumns({
        "reviewed": F.col("_f").isNotNull() | F.coalesce("reviewed", F.lit(False)),
        "feedback": F.coalesce("_f", "feedback")}).drop("_f")


def flag_false_positives(reports: DataFrame, notes: DataFrame, key: str = "id") -> DataFrame:
    given = notes.select(key, F.col("note").alias("_n"))
    return reports.join(given, key, "left").withColumns({
        "false_positive": F.col("_n").isNotNull() | F.coalesce("false_positive", F.lit(False)),
        "user_note": F.coalesce("_n", "user_note")}).drop("_n")


def alertable(df: DataFrame, prefs: DataFrame | None = None, key: str = "user_id") -> DataFrame:
    """Scans that may raise an alert: DANGER and WARNING unless switched off."""
    danger, warning = F.lit(True), F.lit(True)
    out = df
    if prefs is not None:
        out = df.join(prefs.select(key, "alert_danger", "alert_warning"), key, "left")
        danger, warning = F.coalesce("alert_danger", F.lit(True)), F.coalesce("alert_warning", F.lit(True))
    ok = ((F.col("verdict") == "DANGER") & danger) | ((F.col("verdict") == "WARNING") & warning)
    return out.filter(ok).select(*df.columns)


def rows_to_log(df: DataFrame, log_all: bool) -> DataFrame:
    return df.filter(F.lit(log_all) | (F.col("verdict") != "SAFE"))


def get_by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    return df.filter(F.col(key) == value)


def get_by_sender(df: DataFrame, sender: str) -> DataFrame:
    return newest_first(df.filter(F.col("sender") == sender))


def newest_first(df: DataFrame, key: str = "id") -> DataFrame:
    return df.orderBy(F.desc("ts"), F.desc(key))


def most_recent(df: DataFrame, n: int = 5, key: str = "id") -> DataFrame:
    return newest_first(df, key).limit(n)


def by_verdict(df: DataFrame, verdict: str, key: str = "id") -> DataFrame:
    return newest_first(df.filter(F.col("verdict") == verdict), key)


# -- aggregates ------------------------------------------------------------

def dashboard(scans: DataFrame, as_of: Column) -> DataFrame:
    """Counts since the start of the day of ``as_of`` and overall, in one pass."""
    today, v = F.col("ts") >= F.date_trunc("day", as_of), F.col("verdict")
    return scans.agg(
        F.count_if(today).alias("total_today"), F.count_if(today & (v == "DANGER")).alias("dangers_today"),
        F.count_if(today & (v == "SAFE")).alias("safe_today"), F.count_if(today & (v == "WARNING")).alias("warnings_today"),
        F.count(F.lit(1)).alias("total_overall"), F.count_if(v == "SAFE").alias("safe_overall"))


def verdict_rollup(scans: DataFrame) -> DataFrame:
    """Counts per day and verdict with both subtotals and the grand total."""
    daily = scans.select(F.to_date("ts").alias("day"), "verdict")
    sets = [[F.col("day"), F.col("verdict")], [F.col("day")], [F.col("verdict")], []]
    return daily.groupingSets(sets, "day", "verdict").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("grouping_level")).select("day", "verdict", "n", "grouping_level")


def threat_weight(verdict: Column) -> Column:
    return F.when(verdict == "DANGER", 1.0).when(verdict == "WARNING", 0.5).otherwise(0.0)


def sender_reputation(scans: DataFrame, sender: str = "sender") -> DataFrame:
    return scans.groupBy(sender).agg(
        F.avg(threat_weight(F.col("verdict"))).alias("reputation"), F.count(F.lit(1)).alias("n_scans"))


def reputation_asof(scans: DataFrame, sender: str = "sender", ts: str = "ts", row_id: str = "id") -> DataFrame:
    """Reputation from the scans strictly before each scan; no history reads 0."""
    summed = running_sums(scans, [sender], [ts, row_id], {
        "_w": threat_weight(F.col("verdict")), "_n": F.lit(1)})
    return summed.withColumn(
        "reputation", F.when(F.col("_n") > 0, F.col("_w") / F.col("_n")).otherwise(0.0)).drop("_w", "_n")


def suppress_repeats(scans: DataFrame, key: str, content: str, ts: str = "ts", row_id: str = "id",
                     seconds: float = 300) -> DataFrame:
    """Drop scans that repeat the last accepted content within the interval."""
    return spaced_out(scans, [key], ts, row_id, seconds, same=[content])


def stable_files(polls: DataFrame, key: str = "uri", ts: str = "ts", size: str = "size") -> DataFrame:
    """First poll at which a file had the same non-zero size twice in a row."""
    seen = previous_values(polls, [key], [ts], [size])
    settled = seen.filter((F.col(size) > 0) & (F.col(f"prev_{size}") == F.col(size)))
    return settled.groupBy(key).agg(F.min(ts).alias("ready_at"), F.min_by(size, ts).alias(size))


def recent_disagreements(df: DataFrame, keys: list[str], n: int = 20, ts: str = "ts", row_id: str = "id") -> DataFrame:
    return top_n(df.filter(F.col("disagreement") >= 0.25), keys, [F.desc(ts), F.desc(row_id)], n)


def disagreement_summary(df: DataFrame) -> DataFrame:
    """Event count, means and verdict counts of the meaningful disagreements."""
    per_verdict = df.filter(F.col("disagreement") >= 0.25).groupBy("verdict").agg(
        F.count(F.lit(1)).alias("n"), F.sum("disagreement").alias("d"), F.sum("ml_score").alias("s"))
    return per_verdict.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"), (F.sum("d") / F.sum("n")).alias("mean_disagreement"),
        (F.sum("s") / F.sum("n")).alias("mean_ml_score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("verdict", "n")))).alias("verdict_counts"))


def score_disagreement(scores: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Spread of the active model scores per message on the long table."""
    return scores.groupBy(key).agg(
        F.when(F.count_if(F.col(score) > 0) >= 2, F.stddev_pop(F.when(F.col(score) > 0, F.col(score))))
        .otherwise(0.0).alias("disagreement"), F.count_if(F.col(score) > 0).alias("active_models"))


def vote_mean(scores: DataFrame, message: str, url: str, score: str = "score") -> DataFrame:
    """Mean vote per URL (a failed model votes 0.5), the highest URL per message."""
    per_url = scores.groupBy(message, url).agg(F.avg(F.coalesce(F.col(score), F.lit(0.5))).alias("vote"))
    return per_url.groupBy(message).agg(F.max("vote").alias("max_vote")).withColumn("anomaly", F.col("max_vote") > 0.80)


def latency_stats(df: DataFrame, keys: list[str], value: str, accuracy: int = 100_000) -> DataFrame:
    """Mean and 95th percentile; the sketch keeps memory per group bounded."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("avg_latency"), F.percentile_approx(value, 0.95, accuracy).alias("p95_latency"),
        F.count(F.lit(1)).alias("n"))


def count_expired(df: DataFrame, cutoff: Column, ts: str = "ts") -> DataFrame:
    return df.agg(F.count_if(F.col(ts) < cutoff).alias("expired"))


def batch_summary(scans: DataFrame, n: int = 50, key: str = "id") -> DataFrame:
    """Threat counts over the newest ``n`` scans."""
    v = F.upper("verdict")
    return most_recent(scans, n, key).agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(v.isin("DANGER", "WARNING")).alias("threats"),
        F.count_if(v == "DANGER").alias("dangers"), F.count_if(v == "WARNING").alias("warnings"))


# -- downloads and intents -------------------------------------------------

def qualifying_downloads(df: DataFrame, name: str = "name", size: str = "size", path: str = "path") -> DataFrame:
    ext = F.when(F.col(name).contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    where = any_of(F.lower(F.col(path)).contains(d.lower()) for d in lx.DOWNLOAD_DIRECTORIES)
    return df.filter((F.col(size) > 0) & (ext != "") & ~ext.isin(lx.TEMP_EXTENSIONS) & where)


def missed_files(files: DataFrame, claims: DataFrame, as_of: Column, lookback_seconds: int = 120) -> DataFrame:
    """Recent files nobody has claimed."""
    recent = files.filter(F.col("ts") >= as_of - F.make_dt_interval(secs=F.lit(lookback_seconds)))
    return recent.join(claims.select("uri").distinct(), "uri", "left_anti")


def candidate_packages(path: Column) -> Column:
    """Packages whose intent may explain a path, in priority order."""
    lower = F.lower(path)
    chain = None
    for markers, packages in lx.PATH_PACKAGES:
        hit = any_of(lower.contains(m) for m in markers)
        value = F.array(*[F.lit(p) for p in packages])
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.otherwise(F.array().cast("array<string>"))


def _asof_intent(asks: DataFrame, primed: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """``file_id, file_ts`` with the newest live intent at that time (``i``)."""
    intent = F.struct("intent_id", "package", "intent_type", "intent_ts")
    left = asks.select(*keys, F.col("ts").alias("at"), F.lit(1).alias("side"), F.col("file_id").cast("string").alias("row"),
                       "file_id")
    right = primed.select(*keys, F.col("intent_ts").alias("at"), F.lit(0).alias("side"),
                          F.col("intent_id").cast("string").alias("row"), intent.alias("intent"))
    both = left.unionByName(right, allowMissingColumns=True)
    seen = last_before(both, keys, ["at", "side", "row"], "intent", "i").filter(F.col("side") == 1)
    age = F.unix_micros("at") - F.unix_micros("i.intent_ts")
    return seen.filter(age <= seconds * 1_000_000).select("file_id", F.col("at").alias("file_ts"), "i")


def match_intents(files: DataFrame, intents: DataFrame, seconds: int = 15, tenant: list[str] | None = None) -> DataFrame:
    """Attribute each file to a primed intent of a package its path implies.

    ``files``: file_id, path, ts; ``intents``: intent_id, package, intent_type,
    ts. A newer intent of the package replaces the older one, an intent
    lives ``seconds`` and is used once, by the earliest file that asks for it;
    packages are asked in priority order. Each priority level is one as-of
    lookup and one aggregation per intent.
    """
    keys = tenant or []
    open_asks, matched = files.withColumn("_packages", candidate_packages(F.col("path"))), None
    primed = intents.select(*keys, "package", "intent_id", "intent_type", F.col("ts").alias("intent_ts"))
    for level in range(max(len(p) for _, p in lx.PATH_PACKAGES)):
        here = open_asks.withColumn("package", F.get("_packages", F.lit(level))).filter(F.col("package").isNotNull())
        latest = _asof_intent(here, primed, [*keys, "package"], seconds)
        used = latest.select("file_id", "file_ts", "i.*").groupBy("intent_id").agg(
            F.min_by(F.struct("file_id", "package", "intent_type", "intent_ts"), F.struct("file_ts", "file_id")).alias("m"))
        won = used.select("intent_id", "m.*")
        matched = won if matched is None else matched.unionByName(won)
        open_asks = open_asks.join(won.select("file_id"), "file_id", "left_anti")
    return files.join(matched, "file_id", "left")


def latest_intent(files: DataFrame, intents: DataFrame, seconds: int = 15, tenant: list[str] | None = None) -> DataFrame:
    """Most recent unexpired intent of any package at the time of each file."""
    keys = tenant or []
    primed = intents.select(*keys, "package", "intent_id", "intent_type", F.col("ts").alias("intent_ts"))
    best = _asof_intent(files, primed, keys, seconds).select("file_id", "i.*")
    return files.join(best, "file_id", "left")


def latest_claim(claims: DataFrame, keys: list[str], as_of: Column, seconds: int = 10) -> DataFrame:
    """The newest live claim per key group: captured, or pending within its time."""
    live = (F.col("state") != "PENDING_CAPTURE") | (F.col("ts") >= as_of - F.make_dt_interval(secs=F.lit(seconds)))
    kept = claims.filter(live & (F.col("state") != "PROCESSED"))
    return kept.groupBy(*keys).agg(F.max_by("uri", F.struct("ts", "uri")).alias("uri"), F.max("ts").alias("ts"))


# -- feedback folds --------------------------------------------------------

def adapt_weights(feedback: DataFrame, tenant: str = "tenant", ts: str = "ts", row_id: str = "id") -> DataFrame:
    """Ensemble weights per tenant after all its feedback, in time order.

    Each step depends on the one before, so a tenant is one ordered stream:
    rows are sorted on disk by Spark and folded batch by batch in constant
    memory. Needs ``verdict, sub_scores`` (array in component order), ``is_correct``.
    """
    ordered = feedback.select(tenant, ts, row_id, "verdict", "sub_scores", "is_correct").repartition(
        tenant).sortWithinPartitions(tenant, ts, row_id)
    start = [lx.DEFAULT_WEIGHTS[c] for c in lx.COMPONENTS]
    kind = feedback.schema[tenant].dataType.simpleString()

    def fold(batches):
        import pandas as pd

        from riskframe.functions.fusion import weight_step

        current, weights, steps = None, None, 0
        for pdf in batches:
            done = []
            for who, verdict, scores, correct in zip(pdf[tenant], pdf["verdict"], pdf["sub_scores"], pdf["is_correct"]):
                if who != current:
                    if weights is not None:
                        done.append((current, [float(x) for x in weights], steps))
                    current, weights, steps = who, start, 0
                weights, steps = weight_step(weights, scores, verdict, bool(correct)), steps + 1
            if done:
                yield pd.DataFrame(done, columns=[tenant, "weights", "events"])
        if weights is not None:
            yield pd.DataFrame([(current, [float(x) for x in weights], steps)], columns=[tenant, "weights", "events"])

    return ordered.mapInPandas(fold, f"{tenant} {kind}, weights array<double>, events long")
