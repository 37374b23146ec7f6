"""Streaming forms against their batch forms, with data split into several micro-batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskframe.operators.ordered import spaced_out
from riskframe.streaming import streams as st
from riskframe.streaming.history import CaseHistory

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream"))
    rows = [(i, f"k{i % 3 if i % 5 else 0}", START + timedelta(seconds=i * 4), "x" if i % 7 else "y") for i in range(300)]
    for part in range(3):
        spark.createDataFrame(rows[part * 100:(part + 1) * 100], "id long, key string, ts timestamp, content string").coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    schema = "id long, key string, ts timestamp, content string"
    return st.prepare(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "10 minutes")


def test_cooldown_over_batches(spark, landed):
    got = {r["id"] for r in st.run_available(st.cooldown(stream(spark, landed), ["key"], 60)).collect()}
    want = {r["id"] for r in spaced_out(spark.read.parquet(landed), ["key"], "ts", "id", 60).collect()}
    assert got == want


def test_repeats_over_batches(spark, landed):
    got = {r["id"] for r in st.run_available(st.suppress_repeats(stream(spark, landed), ["key"], "content", 90)).collect()}
    want = {r["id"] for r in spaced_out(spark.read.parquet(landed), ["key"], "ts", "id", 90, ["content"]).collect()}
    assert got == want


def test_many_keys_share_a_group_and_stay_apart(spark, tmp_path):
    path, at = str(tmp_path / "m"), lambda s: START + timedelta(seconds=s)
    rows = [(1, "a", at(0), "x"), (2, None, at(1), "x"), (3, "null", at(2), "x"), (4, "a", at(59), "y"), (5, None, at(60), "x"),
            (6, "a", at(60), "y"), (7, None, at(61), "x"), (8, "b", at(61), "x")]
    for part in range(2):
        spark.createDataFrame(rows[part * 4:part * 4 + 4], "id long, key string, ts timestamp, content string").coalesce(1).write.mode("append").parquet(path)
    out = st.cooldown(stream(spark, path), ["key"], 60, buckets=1)
    assert out.columns == ["id", "key", "ts", "content"]
    assert sorted(r["id"] for r in st.run_available(out).collect()) == [1, 2, 3, 6, 7, 8]


def test_a_group_is_handled_in_one_call(monkeypatch):
    import pandas as pd

    from riskframe.streaming.processors import Cooldown

    n, state, cooldown = 5_000, _State(), Cooldown(600, key="_key", helpers=("_key",))
    cooldown.init(state)
    calls = []
    monkeypatch.setattr(_Value, "update", lambda self, value: (calls.append(1), setattr(self, "value", value)))
    rows = pd.DataFrame({"id": range(n), "ts": pd.to_datetime(range(n), unit="s"), "_key": [b"%d" % k for k in range(n)]})
    assert sum(len(out) for out in cooldown.handleInputRows((0,), iter([rows]), None)) == n and len(calls) == 1
    assert list(cooldown.handleInputRows((0,), iter([rows]), None)) == []


def test_claims(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    rows = [("u", at(0), 1, "CLAIM", "a"), ("u", at(5), 2, "CLAIM", "b"), ("u", at(11), 3, "CLAIM", "c"), ("u", at(12), 4, "CAPTURED", "c"),
            ("u", at(60), 5, "CLAIM", "d"), ("u", at(61), 6, "PROCESSED", "c"), ("u", at(62), 7, "CLAIM", "e")]
    path = str(tmp_path / "c")
    spark.createDataFrame(rows, "uri string, ts timestamp, id long, kind string, layer string").coalesce(1).write.parquet(path)
    src = st.prepare(spark).readStream.schema("uri string, ts timestamp, id long, kind string, layer string").parquet(path).withWatermark("ts", "1 minute")
    got = {r["id"]: (r["granted"], r["holder"]) for r in st.run_available(st.claims(src, 10)).collect()}
    assert got == {1: (True, "a"), 2: (False, "a"), 3: (True, "c"), 5: (False, "c"), 7: (True, "e")}


def test_late_rows_are_dropped(spark, tmp_path):
    path = str(tmp_path / "late")
    schema = "id long, key string, ts timestamp, content string"
    first = [(1, "k", START + timedelta(hours=2), "x")]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(path)
    import time
    time.sleep(1.1)
    spark.createDataFrame([(2, "k", START + timedelta(hours=4), "x"), ], schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)
    spark.createDataFrame([(3, "k", START, "x")], schema).coalesce(1).write.mode("append").parquet(path)
    got = {r["id"] for r in st.run_available(st.cooldown(stream(spark, path), ["key"], 10)).collect()}
    assert 3 not in got and {1, 2} <= got


MESSAGES = ("email_id int, sender string, reply_to string, return_path string, subject string, body_text string, authentication_results string, "
            "raw_headers map<string,string>, received_headers array<string>, attachment_hashes array<string>")


def _message(i, sender, body="lunch", ip=None, digest=None):
    return (i, sender, "", "", "hi", body, "", {"x-originating-ip": ip} if ip else {}, [], [digest] if digest else [])


def test_triage_over_a_growing_history(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [_message(1, "x@evil.com", "see http://bad.site.com/a"), _message(2, "a@b.com", ip="8.8.4.4")],
        [_message(3, "y@evil.com", ip="8.8.4.4"), _message(4, "q@other.net", "go to http://bad.site.com/b and http://new.org", digest="ab" * 32)],
        [_message(5, "z@third.org", digest="ab" * 32), _message(1, "x@evil.com", "see http://bad.site.com/a again")]]

    def run():
        read = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(src)
        st.triage_batches(read, out, f"{out}/checkpoint", buckets=4).awaitTermination()

    for rows in batches[:2]:
        spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(src)
        run()
    history = CaseHistory(spark, f"{out}/history", 4)
    before = sorted(history.values().collect())
    history.compact(1)
    assert sorted(history.values().collect()) == before and history.batches(9) == [1]
    spark.createDataFrame(batches[2], MESSAGES).coalesce(1).write.mode("append").parquet(src)
    run()
    run()  # nothing new: nothing changes
    links = {(r["case_id"], r["indicator_type"], r["target_case_id"], r["value_case_count"]) for r in spark.read.parquet(f"{out}/links").collect()}
    assert links == {
        ("3", "sender_domain", "1", 2), ("3", "origin_ip", "2", 2), ("4", "url_domain", "1", 2), ("5", "attachment_hash", "4", 2),
        ("1", "sender_domain", "3", 2), ("1", "url_domain", "4", 2)}
    assert {r["normalized_value"]: r["case_count"] for r in history.values().collect() if r["case_count"] > 1} == {
        "evil.com": 2, "8.8.4.4": 2, "bad.site.com": 2, "ab" * 32: 2}
    assert history.cases().count() == 5 and spark.read.parquet(f"{out}/verdicts").count() == 6


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    history = CaseHistory(spark, str(tmp_path / "h"), 4)
    case = lambda *ids: spark.createDataFrame([(i, START, "s", "SAFE", 1, "SAFE") for i in ids], "case_id string, ts timestamp, sender string, verdict string, risk_score int, primary_category string")
    ind = lambda *rows: spark.createDataFrame([(i, "url_domain", v, v) for i, v in rows], "case_id string, indicator_type string, indicator_value string, normalized_value string")
    history.add(case("a", "b"), ind(("a", "x.com"), ("b", "x.com")), 0).collect()
    history.commit(0)
    first = sorted(history.add(case("c"), ind(("c", "x.com")), 1).collect())
    second = sorted(history.add(case("c"), ind(("c", "x.com")), 1).collect())  # lost before its commit
    history.commit(1)
    assert first == second and {r["target_case_id"] for r in first} == {"a", "b"} and first[0]["value_case_count"] == 3
    assert [tuple(r)[:2] for r in history.values().collect()] == [("x.com", 3)]


def test_cached_lookup_expires(spark, tmp_path):
    path = str(tmp_path / "l")
    spark.createDataFrame([(1, "k", START + timedelta(minutes=5)), (2, "k", START + timedelta(minutes=20))], "id int, key string, ts timestamp").write.parquet(path)
    dim = spark.createDataFrame([("k", "v", START)], "key string, val string, fetched_at timestamp")
    src = spark.readStream.schema("id int, key string, ts timestamp").parquet(path)
    got = {r["id"]: r["val"] for r in st.run_available(st.cached_lookup(src, dim, "key")).collect()}
    assert got == {1: "v", 2: None}


def test_daily_counts_close_with_the_watermark(spark, landed):
    out = st.run_available(st.daily_counts(stream(spark, landed), F.col("content")))
    assert out.count() == 0  # the only day is still open


def test_a_heartbeat_closes_the_last_window(spark, landed):
    beat = st.Heartbeat(spark)
    raw = st.prepare(spark).readStream.schema("id long, key string, ts timestamp, content string").parquet(landed)
    out = st.run_available(st.daily_counts(beat.with_watermark(raw), F.col("content")), heartbeat=beat)
    assert sorted((r["verdict"], r["n"]) for r in out.collect()) == [("x", 257), ("y", 43)]


def test_intents_are_used_once(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    wa, dl = "/media/com.whatsapp/x.pdf", "/Download/a.pdf"
    gm, chrome, provider = "com.google.android.gm", "com.android.chrome", "com.android.providers.downloads"
    intents = [(1, 10, "com.whatsapp", "tap", at(0)), (1, 11, gm, "tap", at(100)), (1, 12, chrome, "notice", at(101)), (2, 13, gm, "tap", at(100)),
               (1, 14, provider, "tap", at(200)), (1, 15, provider, "tap", at(204)), (1, 16, "com.other", "tap", at(204)), (1, 17, gm, "tap", at(300))]
    files = [(1, 1, wa, at(5)), (1, 2, wa, at(6)), (1, 3, dl, at(103)), (1, 4, dl, at(104)), (1, 5, dl, at(105)), (2, 6, dl, at(100)),
             (2, 7, dl, at(101)), (1, 8, dl, at(219)), (1, 9, dl, at(219)), (1, 10, "/DCIM/a.jpg", at(1)), (1, 11, dl, at(316)), (1, 12, dl, at(299))]
    want = {1: 10, 2: None, 3: 11, 4: 12, 5: None, 6: 13, 7: None, 8: 15, 9: None, 10: None, 11: None, 12: None}
    f, i = str(tmp_path / "f"), str(tmp_path / "i")
    fs, js = "tenant long, file_id long, path string, ts timestamp", "tenant long, intent_id long, package string, intent_type string, ts timestamp"
    for part in range(3):  # rows of a moment are spread over micro-batches
        spark.createDataFrame(files[part::3], fs).coalesce(1).write.mode("append").parquet(f)
        spark.createDataFrame(intents[part::3], js).coalesce(1).write.mode("append").parquet(i)
    read = lambda schema, path: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    beat = st.Heartbeat(spark)
    rows = beat.with_watermark(st.intent_rows(read(fs, f), read(js, i)))
    got = st.run_available(st.match_intents(rows, 15), heartbeat=beat).collect()
    assert {r["file_id"]: r["intent_id"] for r in got} == want and len(got) == len(want)
    one = next(r for r in got if r["file_id"] == 4)
    assert (one["tenant"], one["package"], one["intent_type"], one["intent_ts"], one["file_ts"]) == (1, chrome, "notice", at(101), at(104))


def test_a_heartbeat_lets_the_last_files_out(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    f, i = str(tmp_path / "f"), str(tmp_path / "i")
    fs, js = "tenant long, file_id long, path string, ts timestamp", "tenant long, intent_id long, package string, intent_type string, ts timestamp"
    spark.createDataFrame([(1, 1, "/Download/a.pdf", at(9)), (1, 2, "/DCIM/a.jpg", at(9)), (1, 3, "/Download/b.pdf", at(3600))], fs).write.parquet(f)
    spark.createDataFrame([(1, 10, "com.android.chrome", "tap", at(1)), (1, 11, "com.other", "tap", at(1))], js).write.parquet(i)
    read = lambda schema, path: spark.readStream.schema(schema).parquet(path)
    beat = st.Heartbeat(spark)
    rows = beat.with_watermark(st.intent_rows(read(fs, f), read(js, i)))
    got = st.run_available(st.match_intents(rows, 15), heartbeat=beat).collect()
    assert sorted((r["file_id"], r["intent_id"]) for r in got) == [(1, 10), (2, None), (3, None)]


def test_cached_lookup_takes_the_newest_version_before_the_event(spark, tmp_path):
    path = str(tmp_path / "v")
    at = lambda m: START + timedelta(minutes=m)
    spark.createDataFrame([(1, "k", at(5)), (2, "k", at(9)), (3, "k", at(30)), (4, "z", at(5))], "id int, key string, ts timestamp").write.parquet(path)
    dim = spark.createDataFrame([("k", "old", START), ("k", "new", at(8)), ("k", "later", at(40))], "key string, val string, fetched_at timestamp")
    src = spark.readStream.schema("id int, key string, ts timestamp").parquet(path)
    got = [(r["id"], r["val"]) for r in st.run_available(st.cached_lookup(src, dim, "key")).collect()]
    assert sorted(got) == [(1, "old"), (2, "new"), (3, None), (4, None)]


class _State(dict):
    """A state handle in plain Python, for processors without Spark."""

    def getMapState(self, name, *_):
        return self.setdefault(name, _Map())

    def getValueState(self, name, *_):
        return self.setdefault(name, _Value())

    def listTimers(self):
        return []

    def registerTimer(self, at):
        self["timer"] = at


class _Map(dict):
    def updateValue(self, key, value):
        self[key] = value

    def getValue(self, key):
        return self[key]

    def removeKey(self, key):
        del self[key]


class _Value:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_key_of_a_million_rows_holds_one_frame_at_a_time():
    import weakref

    import numpy as np
    import pandas as pd

    from riskframe.streaming.processors import Cooldown

    rng = np.random.default_rng(1)
    alive, most, n = [], 0, 1_000_000
    at = rng.permutation(n)

    def frames():
        nonlocal most
        for k in range(0, n, 20_000):
            part = at[k:k + 20_000]
            pdf = pd.DataFrame({"id": part, "ts": pd.to_datetime(part.astype("int64"), unit="s"), "text": ["row"] * len(part)})
            alive.append(weakref.ref(pdf))
            yield pdf
            most = max(most, sum(r() is not None for r in alive))

    state, cooldown = _State(), Cooldown(600)
    cooldown.init(state)
    got = [int(i) for out in cooldown.handleInputRows(("k",), frames(), None) for i in out["id"]]
    assert sorted(got) == list(range(0, n, 600)) and most <= 4 and not state["waiting"]
    assert list(cooldown.handleInputRows(("k",), iter([pd.DataFrame({"id": [n], "ts": [pd.to_datetime(n, unit="s")], "text": ["x"]})]), None)) == []
