import json

import pytest
from pyspark.sql import functions as F

from riskframe.schemas import SCANS
from riskframe.sources import mail as ml
from riskframe.sources import tables as tb
from riskframe.sources import writers as wr

EML = b"""From: Eve <eve@bad.com>\r\nTo: a@b.com, c@d.com\r\nReply-To: x@y.com\r\nSubject: Hi\r\nMessage-ID: <1@x>\r
Received: from top by mx.google.com\r\nReceived: from low by isp\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r
--B\r\nContent-Type: text/plain\r\n\r\nsee http://a.com. now\r\n--B\r\nContent-Type: application/pdf; name=f.pdf\r
Content-Disposition: attachment; filename=f.pdf\r\n\r\nDATA\r\n--B--\r\n"""


def test_eml(spark, tmp_path):
    import hashlib
    (tmp_path / "a.eml").write_bytes(EML)
    (tmp_path / "nofrom.eml").write_bytes(b"Subject: x\r\n\r\nbody")
    (tmp_path / "bad.eml").write_bytes(b"Content-Type: multipart/mixed; boundary=\r\n\r\n--\r\n" + b"\xff" * 50)
    rows = {r["provider_message_id"]: r for r in ml.read_eml(spark, str(tmp_path)).collect()}
    assert ml.read_eml(spark, str(tmp_path)).count() == 3
    r = rows["<1@x>"]
    assert r["sender"] == "Eve <eve@bad.com>" and r["recipients"] == ["a@b.com", "c@d.com"] and r["reply_to"] == "x@y.com"
    assert r["received_headers"] == ["from top by mx.google.com", "from low by isp"] and r["urls"] == ["http://a.com"]
    assert r["attachments"][0]["sha256"] == hashlib.sha256(b"DATA").hexdigest() and r["parse_error"] is None


def test_graph_json(spark, tmp_path):
    doc = {"id": "m1", "subject": "S", "from": {"emailAddress": {"name": "N", "address": "n@x.com"}},
           "toRecipients": [{"emailAddress": {"address": "t@x.com"}}], "body": {"contentType": "HTML", "content": "<a href='http://h.com'>"},
           "internetMessageHeaders": [{"name": "Received", "value": "r1"}, {"name": "received", "value": "r2"}, {"name": "Authentication-Results", "value": "spf=pass"}]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    r = ml.read_graph_json(spark, str(tmp_path)).first()
    assert r["sender"] == "N <n@x.com>" and r["received_headers"] == ["r1", "r2"] and r["authentication_results"] == "spf=pass"
    assert r["body_text"] == "" and r["body_html"].startswith("<a") and r["raw_headers"]["received"] == "r2"


def test_triggers_drop_blank_rows(spark, tmp_path):
    rows = [{"sender": "a", "subject": "", "snippet": "s"}, {"sender": " ", "subject": ""}, {"sender": "", "subject": "b", "body": "x"}]
    (tmp_path / "t.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = {r["body_text"]: r["full_payload"] for r in ml.read_triggers(spark, str(tmp_path)).collect()}
    assert got == {"s": False, "x": True}
    assert ml.read_triggers(spark, str(tmp_path), stream=True).isStreaming


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "ok.csv").write_text('text,label,extra\n"hi, you",1,x\nbye,zero,y\n')
    assert [tuple(r) for r in tb.read_labelled_csv(spark, str(tmp_path / "ok.csv")).collect()] == [("hi, you", 1), ("bye", None)]
    (tmp_path / "bad.csv").write_text("message,label\na,1\n")
    with pytest.raises(ValueError, match="text"):
        tb.read_labelled_csv(spark, str(tmp_path / "bad.csv"))


def test_raw_features_and_metadata(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"sha256":"1","label":1,"appeared":"2018-01","big":[1,2]}\n{"sha256":"2","label":-1}\n')
    (tmp_path / "b.jsonl").write_text('{"sha256":"3","label":0}\n')
    train, test = tb.read_raw_features(spark, [str(tmp_path / "a.jsonl")]), tb.read_raw_features(spark, [str(tmp_path / "b.jsonl")])
    meta = tb.build_metadata(train, test)
    assert {(r["sha256"], r["subset"]) for r in meta.collect()} == {("1", "train"), ("2", "train"), ("3", "test")}
    assert tb.labelled(meta).count() == 2


def test_schema_evolution(spark):
    old = spark.createDataFrame([(1, "SAFE")], "id int, verdict string")
    row = tb.evolve(old, SCANS, {"reviewed": False, "reputation": 0.0}).first()
    assert row["reviewed"] is False and row["reputation"] == 0.0 and row["sender"] is None


def test_export_and_packing(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "SAFE")], "id int, flags array<string>, verdict string").withColumn("ts", F.to_timestamp(F.lit("2024-01-01 10:00:00")))
    wr.export_scans(df, str(tmp_path / "x"), "2024-01-07")
    row = spark.read.option("header", True).csv(str(tmp_path / "x")).first()
    assert row["red_flags"] == "a; b" and row["timestamp"] == "2024-01-01 10:00:00" and len(wr.export_frame(df).columns) == 16
    packed = wr.pack_region_scans(spark.createDataFrame([(["u1", "u2"], ["x", "y"])], "urls array<string>, actions array<string>"))
    assert tuple(packed.first()) == ("u1,u2", "x|y")
    assert wr.unpack_region_scans(packed).first()["actions"] == ["x", "y"]


def test_versioned_table(spark, tmp_path):
    path = str(tmp_path / "t")
    wr.replace_table(spark.range(3), path)
    wr.replace_table(wr.read_current(spark, path).filter("id > 0"), path)
    assert wr.read_current(spark, path).count() == 2


def test_sql_functions(spark):
    from riskframe.functions.sql import register_functions
    assert register_functions(spark) == ["auth_status", "ip_class", "mask_email", "redact_pii", "url_entropy"]
    r = spark.sql("SELECT ip_class('10.1.2.3') a, ip_class('x') b, mask_email('bob@x.com') c, round(url_entropy('aabb'), 3) d, redact_pii('a 123-45-6789') e").first()
    assert tuple(r) == ("PRIVATE", "INVALID", "b***@x.com", 1.0, "a [REDACTED_SSN]")


def test_training(spark):
    from riskframe.operators import ml as tr
    data = tr.synthetic_urls(spark, 400, seed=1)
    assert data.count() == 400 and 0.2 < data.agg(F.avg("label")).first()[0] < 0.55
    names = [c for c in data.columns if c not in ("id", "url", "label")]
    split = tr.stratified_split(data, "label", "id", 0.8)
    assert split.filter("is_train").count() in (319, 320)
    df = tr.assemble(split, names).withColumn("label", F.col("label").cast("double"))
    model = tr.boosted_trees(rounds=3).fit(df.filter("is_train"))
    scored = tr.score_vectors(model, df.filter("NOT is_train"), 0.5, width=len(names))
    assert tr.roc_auc(scored) > 0.7
    iso = tr.fit_isotonic(scored.select(F.col("probability").alias("score"), "label"))
    assert list(iso.predictions) == sorted(iso.predictions)
    tiles = tr.time_folds(spark.range(10).withColumnRenamed("id", "t"), ["t"], 3)
    assert [r["tile"] for r in tiles.orderBy("t").collect()] == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4]
    assert [(a.count(), b.count()) for a, b in tr.fold_frames(tiles)] == [(3, 3), (6, 2), (8, 2)]
