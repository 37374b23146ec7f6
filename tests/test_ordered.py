"""Order-dependent operators against a plain Python reading, on skewed keys."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskframe.operators import history as hs
from riskframe.operators import ordered as od
from riskframe.operators.joins import lookup_join, top_n

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out, t = [], 0.0
    for i in range(3000):
        t += rng.choice([0.2, 1, 5, 40])
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}"
        out.append((i, key, START + timedelta(seconds=round(t, 1)), rng.randrange(3), rng.choice(["SAFE", "WARNING", "DANGER"])))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, ts timestamp, v int, verdict string").repartition(6)


def test_global_rank(frame, rows):
    got = {r["id"]: r["rank"] for r in od.global_rank(frame, ["ts", "id"]).collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}


def test_running_sums_cross_partitions(frame, rows):
    got = {r["id"]: r["s"] for r in od.running_sums(frame, ["key"], ["ts", "id"], {"s": F.col("v")}).collect()}
    acc, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        want[r[0]] = acc.get(r[1], 0)
        acc[r[1]] = want[r[0]] + r[3]
    assert got == want


def test_previous_values(frame, rows):
    got = {r["id"]: r["prev_v"] for r in od.previous_values(frame, ["key"], ["ts", "id"], ["v"]).collect()}
    last, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        want[r[0]] = last.get(r[1])
        last[r[1]] = r[3]
    assert got == want


def test_last_before(frame, rows):
    df = frame.withColumn("x", F.when(F.col("v") == 2, F.col("id")))
    got = {r["id"]: r["y"] for r in od.last_before(df, ["key"], ["ts", "id"], "x", "y").collect()}
    last, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        if r[3] == 2:
            last[r[1]] = r[0]
        want[r[0]] = last.get(r[1])
    assert got == want


@pytest.mark.parametrize("same", [[], ["v"]])
def test_spaced_out(frame, rows, same):
    got = {r["id"] for r in od.spaced_out(frame, ["key"], "ts", "id", 30, same).collect()}
    state, want = {}, set()
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        held = state.get(r[1])
        value = r[3] if same else None
        if held is None or (r[2] - held[0]).total_seconds() >= 30 or held[1] != value:
            state[r[1]] = (r[2], value)
            want.add(r[0])
    assert got == want


@pytest.mark.parametrize("seconds", [3, 47, 5000, 10**6])
def test_one_endless_run_is_many_tasks(spark, seconds):
    """Steady times never let two chains meet; equal times and a NULL key are in it as well."""
    rng = random.Random(seconds)
    times = sorted([float(i) for i in range(4000)] + [round(rng.random() * 4000, 3) for _ in range(500)] + [1000.0] * 40)
    rows = [(i, k, START + timedelta(seconds=t)) for k in (None, "a") for i, t in enumerate(times)]
    df = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "id long, key string, ts timestamp")
    state, want = {}, set()
    for n, (_, key, at) in enumerate(rows):
        if key not in state or (at - state[key]).total_seconds() >= seconds:
            state[key] = at
            want.add(n)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = od.spaced_out(df, ["key"], "ts", "id", seconds)
        assert {r["id"] for r in got.collect()} == want and got.columns == df.columns
        assert got.rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_reputation_uses_only_the_past(frame, rows):
    got = {r["id"]: r["reputation"] for r in hs.reputation_asof(frame, "key").collect()}
    weight, seen = {"SAFE": 0.0, "WARNING": 0.5, "DANGER": 1.0}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        past = seen.setdefault(r[1], [])
        assert abs(got[r[0]] - (sum(past) / len(past) if past else 0.0)) < 1e-9
        past.append(weight[r[4]])


def test_lookup_join_equals_plain_join_and_spreads_null_keys(spark, frame):
    from pyspark.sql import functions as F

    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "key string, w int")
    missing = frame.withColumn("key", F.when(F.col("id") % 10 == 0, F.col("key")))
    for rows in (frame, missing):
        for how in ("left", "inner", "left_semi", "left_anti"):
            columns = ["id"] if how.startswith("left_") else ["id", "w"]
            a = sorted(map(tuple, lookup_join(rows, dim, "key", how).select(*columns).collect()), key=repr)
            assert a == sorted(map(tuple, rows.join(dim, "key", how).select(*columns).collect()), key=repr)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        many = spark.range(40_000).select("id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), F.col("id") % 7)).alias("key"))
        sizes = [r["n"] for r in lookup_join(many, dim, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 0.5 * sum(sizes)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_null_keys_carry_over_partition_borders(spark):
    from pyspark.sql import functions as F

    from riskframe.operators.ordered import last_before, running_sums

    rows = spark.range(1000).select("id", F.lit(None).cast("string").alias("key"), F.when(F.col("id") % 100 == 0, F.col("id")).alias("v")).repartition(6)
    got = running_sums(rows, ["key"], ["id"], {"n": F.lit(1)}).collect()
    assert all(r["n"] == r["id"] for r in got) and len(got) == 1000
    assert all(r["l"] == r["id"] // 100 * 100 for r in last_before(rows, ["key"], ["id"], "v", "l").collect())


def test_a_cluster_without_a_shared_folder_is_refused():
    import types

    from riskframe.session import shared_root

    def session(master, folder=None):
        conf = types.SimpleNamespace(get=lambda k, d=None: folder)
        context = types.SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master=master)
        return types.SimpleNamespace(sparkContext=context)

    with pytest.raises(RuntimeError):
        shared_root(session("spark://head:7077"))
    assert shared_root(session("spark://head:7077", "hdfs:///shared")) == "hdfs:///shared"
    assert shared_root(session("local[4]"))


def test_top_n_limits_before_the_shuffle(frame):
    plan = top_n(frame, ["key"], [F.col("ts"), F.col("id")], 3)
    assert plan.groupBy("key").count().filter("count > 3").count() == 0
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_intents_are_used_once_and_by_priority(spark):
    at = lambda s: START + timedelta(seconds=s)
    intents = spark.createDataFrame([(1, "com.android.chrome", "D", at(0)), (2, "com.google.android.gm", "D", at(1)), (3, "com.whatsapp", "D", at(1))],
                                    "intent_id long, package string, intent_type string, ts timestamp")
    files = spark.createDataFrame([(10, "/x/Download/a", at(5)), (11, "/x/Download/b", at(6)), (12, "/x/Download/c", at(7)),
                                   (13, "/media/com.whatsapp/WhatsApp/d", at(60)), (14, "/DCIM/e", at(2))], "file_id long, path string, ts timestamp")
    got = {r["file_id"]: r["intent_id"] for r in hs.match_intents(files, intents).collect()}
    assert got == {10: 2, 11: 1, 12: None, 13: None, 14: None}
    got = {r["file_id"]: r["intent_id"] for r in hs.latest_intent(files, intents).collect()}
    assert got[14] == 3 or got[14] == 2
    assert got[13] is None


def test_stable_files(spark):
    polls = spark.createDataFrame([("a", START, 0), ("a", START + timedelta(seconds=1), 5), ("a", START + timedelta(seconds=2), 5),
                                   ("b", START, 0), ("b", START + timedelta(seconds=1), 0)], "uri string, ts timestamp, size int")
    assert [(r["uri"], r["size"]) for r in hs.stable_files(polls).collect()] == [("a", 5)]


def test_adaptive_weights_stay_normalised(spark):
    fb = spark.createDataFrame([("t", START + timedelta(seconds=i), i, v, s, c) for i, (v, s, c) in enumerate(
        [("DANGER", [0.9, 0.1, 0.0, 0.0, 0.0], False), ("SAFE", [0.1, 0.9, 0.5, 0.5, 0.5], False), ("WARNING", [0.2, 0.8, 0.1, 0.0, 0.0], True)])],
        "tenant string, ts timestamp, id long, verdict string, sub_scores array<double>, is_correct boolean")
    row = hs.adapt_weights(fb).first()
    assert row["events"] == 3 and abs(sum(row["weights"]) - 1) < 1e-9
    assert all(0.04 <= w <= 0.61 for w in row["weights"])
