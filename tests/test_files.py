import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.operators import apps as ap
from riskframe.operators import files as fx
from riskframe.sources.files import archive_parts, inflated_streams, read_files

HEAD = b"%PDF-1.4\n"
CASES = {
    "clean.pdf": HEAD + b"1 0 obj << /Type /Catalog >> endobj\n%%EOF",
    "goto.pdf": HEAD + b"1 0 obj << /Type /Catalog /OpenAction 2 0 R >> endobj 2 0 obj << /S /GoTo >> endobj\n%%EOF",
    "js.pdf": HEAD + b"1 0 obj << /Type /Catalog /OpenAction 2 0 R >> endobj 2 0 obj << /S /JavaScript /JS (x) >> endobj\n%%EOF",
    "embedded.pdf": HEAD + b"1 0 obj << /Type /Catalog /Names 2 0 R >> endobj 2 0 obj << /EmbeddedFiles (a.exe) >> endobj\n%%EOF",
    "orphan.pdf": HEAD + b"1 0 obj << /Type /Catalog >> endobj 8 0 obj << /EmbeddedFiles (a.exe) >> endobj\n%%EOF",
    "cycle.pdf": HEAD + b"1 0 obj << /Type /Catalog /A 2 0 R >> endobj 2 0 obj << /B 1 0 R /EmbeddedFiles (x.txt) >> endobj\n%%EOF",
    "noeof.pdf": HEAD + b"1 0 obj << /Type /Catalog >> endobj",
    "launch.pdf": HEAD + b"1 0 obj << /Type /Catalog /OpenAction << /S /Launch >> >> endobj\n%%EOF",
    "packed.pdf": HEAD + b"1 0 obj << /Type /Catalog >> endobj 3 0 obj << /Filter /FlateDecode >> stream\n" + zlib.compress(b"/JavaScript app.alert(1)") + b"\nendstream endobj\n%%EOF",
    "trojan.apk": b"PK\x03\x04AndroidManifest.xml android.permission.BIND_ACCESSIBILITY_SERVICE android.permission.RECEIVE_BOOT_COMPLETED android.permission.READ_SMS",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    for name, data in CASES.items():
        (path / name).write_bytes(data)
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("_rels/.rels", '<Relationship TargetMode="External" Target="attachedTemplate"/>')
        z.writestr("word/vbaProject.bin", b"x")
        z.writestr("word/media/i.png", b"x")
    (path / "macro.docx").write_bytes(box.getvalue())
    return str(path)


def test_scan(spark, folder):
    files = read_files(spark, folder)
    out = {r["name"]: r for r in fx.scan_files(files, inflated_streams(files)).collect()}
    verdict = {n: (r["verdict"], r["threat_score"]) for n, r in out.items()}
    assert verdict["clean.pdf"] == ("SAFE", 0)
    assert verdict["goto.pdf"] == ("SUSPICIOUS", 30)
    assert verdict["js.pdf"][0] == "MALICIOUS" and verdict["embedded.pdf"] == ("MALICIOUS", 85)
    assert verdict["orphan.pdf"] == ("SUSPICIOUS", 30) and verdict["cycle.pdf"] == ("SUSPICIOUS", 30)
    assert verdict["noeof.pdf"] == ("SUSPICIOUS", 50) and verdict["launch.pdf"] == ("MALICIOUS", 100)
    assert verdict["packed.pdf"] == ("MALICIOUS", 80)
    assert verdict["trojan.apk"] == ("MALICIOUS", 85)
    assert out["macro.docx"]["file_type"] == "OFFICE" and out["trojan.apk"]["file_type"] == "APK"


def test_empty_file_is_inconclusive(spark):
    df = spark.createDataFrame([("e", "empty.bin", 0, bytearray(b""))], "file_id string, name string, size long, content binary")
    row = fx.scan_files(df).first()
    assert row["verdict"] == "INCONCLUSIVE" and row["threat_score"] == 0 and row["findings"][0]["severity"] == 0


def test_inflation_limits(spark):
    bomb = HEAD + b"<< /FlateDecode >> stream\n" + zlib.compress(b"A" * 5000) + b"\nendstream"
    df = spark.createDataFrame([("b", bytearray(bomb)), ("c", bytearray(HEAD + b"<< /FlateDecode >> stream\nnot zlib\nendstream"))], "file_id string, content binary")
    got = {r["file_id"]: r for r in inflated_streams(df, max_total=1000).collect()}
    assert got["b"]["bomb"] and got["b"]["inflated"] == "" and not got["c"]["bomb"]


def test_parts_and_ooxml(spark, folder):
    parts = archive_parts(read_files(spark, folder).filter("name = 'macro.docx'"))
    row = fx.ooxml_features(parts).first()
    assert (row["RELATIONSHIP_COUNT"], row["EXTERNAL_RELATIONSHIP_COUNT"], row["VBA_PROJECT_PRESENT"], row["EMBEDDED_FILE_COUNT"], row["REMOTE_TEMPLATE_COUNT"]) == (1, 1, 1, 1, 1)


def test_entropy_finding(spark):
    none = "array<struct<category:string,description:string,severity:int>>"
    def run(e, pdf, raw, sev):
        found = F.array(F.struct(F.lit("SUSPICIOUS_MIME_MISMATCH").alias("category"), F.lit("x").alias("description"), F.lit(sev).alias("severity"))) if sev else F.array().cast(none)
        df = spark.range(1).select(found.alias("findings"), F.lit(e).alias("entropy"), F.lit(5000).alias("size"), F.lit(pdf).alias("is_pdf"), F.lit(bool(raw)).alias("has_flate"))
        return [f["severity"] for f in fx.with_entropy_finding(df).first()["findings"] if f["category"] == "HIGH_ENTROPY_PACKED"]
    assert run(7.67, True, "/FlateDecode", 0) == [1] and run(7.95, True, "/FlateDecode", 5) == [6]
    assert run(7.6, False, "", 0) == [3] and run(7.5, False, "", 0) == []


def test_findings_json_round_trip(spark):
    bad = spark.createDataFrame([('[{"cat":"A","desc":"d","sev":3}]',), ("not json",), ("",)], "j string")
    got = [r["f"] for r in bad.select(fx.findings_from_json(F.col("j")).alias("f")).collect()]
    assert [(f["category"], f["severity"]) for f in got[0]] == [("A", 3)] and got[1] == [] and got[2] == []


def test_macro_vector(spark):
    source = 'Sub AutoOpen()\nShell "powershell http://a.com/x"\nEnd Sub'
    df = spark.createDataFrame([(1, source, "", 100, 7.2, True, False, 1, 3)],
                               "file_id int, source string, bytes_text string, size long, entropy double, is_ole boolean, is_ooxml boolean, module_count int, vba_lines int")
    row = fx.macro_features(df).first()
    assert len(row) == 1 + len(lx.OFFICE_FEATURES) == 103
    assert row["HAS_AUTOEXEC"] == 1 and row["AUTOEXEC_SHELL_COMBINATION"] == 1 and row["NETWORK_AND_EXECUTION"] == 1
    assert row["HIGH_ENTROPY"] == 1 and row["LINE_COUNT"] == 3 and row["VBA_PRESENT_WITH_OLE"] == 1 and row["VBA_PRESENT_WITH_OOXML"] == 0
    assert row["SHELL_COUNT"] == source.lower().count("shell") and row["MAX_STRING_LENGTH"] == len("powershell http://a.com/x")


def test_url_evidence(spark):
    rows = [(1, "ObjectPool/a", "x http://e.com/a.application?x y"), (1, "WordDocument", "http://e.com/r.txt and http://e.com/b.exe."), (2, "W", "none")]
    got = fx.url_evidence(fx.stream_urls(spark.createDataFrame(rows, "file_id int, stream string, text string"))).collect()
    assert [tuple(r) for r in got] == [(1, 3, 2, 1, 1)]


def test_app_risk(spark):
    p = lx.PERMISSION_PREFIX
    pin = dict(lx.BANK_CERTIFICATES)["net.one97.paytm"]
    rows = [("net.one97.paytm", "Paytm", "com.android.vending", [], False, pin, False),
            ("com.fake.hdfc", "HDFC", None, [p + "READ_SMS"], False, None, False),
            ("com.phonepe.app", "PhonePe", "com.android.vending", [], False, "00", False),
            ("com.whatsapp", "WhatsApp", "com.android.vending", [p + "READ_SMS", p + "RECEIVE_SMS"], False, None, False),
            ("org.trojan", "T", None, [p + "READ_SMS", p + "RECEIVE_SMS", p + "SYSTEM_ALERT_WINDOW"], True, None, False),
            ("android.sys", "Sys", None, [p + "READ_SMS"], True, None, True)]
    got = {r["package"]: r for r in ap.app_risk(spark.createDataFrame(
        rows, "package string, label string, installer string, permissions array<string>, accessibility_active boolean, cert_sha256 string, system boolean")).collect()}
    assert got["net.one97.paytm"]["cert_status"] == "MATCH_VERIFIED" and got["net.one97.paytm"]["risk_level"] == "SAFE"
    assert got["com.fake.hdfc"]["risk_score"] == 95 and got["com.fake.hdfc"]["cert_status"] == "UNVERIFIED_MISSING_HASH"
    assert got["com.phonepe.app"]["risk_score"] == 100 and got["org.trojan"]["risk_score"] == 100 and got["org.trojan"]["should_alert"]
    assert "com.whatsapp" not in got and "android.sys" not in got


def test_package_vector(one):
    perms = [lx.PERMISSION_PREFIX + x for x in ("READ_SMS", "REQUEST_INSTALL_PACKAGES", "SYSTEM_ALERT_WINDOW")]
    v = one(fx.package_vector(F.col("p")), p=perms)
    assert len(v) == 64 and sum(v[:50]) == 3 and v[50:54] == [1, 1, 0, 0] and abs(v[54] - 0.06) < 1e-9 and abs(v[55] - 0.03) < 1e-9
    assert abs(one(fx.package_fallback(F.col("p")), p=perms) - 0.60) < 1e-9


def test_plain_summary_names_every_kind_of_finding(spark):
    from pyspark.sql import functions as F

    from riskframe.operators.files import plain_summary

    kind = "array<struct<category:string,description:string,severity:int>>"
    rows = [("MALICIOUS", [("EMBEDDED_JAVASCRIPT", "", 4), ("EMBEDDED_EXECUTABLE", "", 9), ("EMBEDDED_JAVASCRIPT", "", 2)]), ("SAFE", []),
            ("INCONCLUSIVE", []), ("SUSPICIOUS", [("ODD_KIND", "", 1)])]
    df = spark.createDataFrame(rows, f"verdict string, findings {kind}")
    got = {r["verdict"]: r["s"] for r in df.select("verdict", plain_summary(F.col("verdict"), F.col("findings")).alias("s")).collect()}
    assert got["MALICIOUS"] == "Rated malicious: it can start another program, it carries script code. Delete it unopened."
    assert got["SAFE"] == "Rated safe: nothing unusual was found in it. No action is needed."
    assert got["SUSPICIOUS"].startswith("Rated suspicious: it shows signs of odd kind.") and "treat it with care" in got["INCONCLUSIVE"]


def test_a_bomb_hides_no_other_stream(spark):
    import zlib

    from riskframe.sources.files import inflated_streams

    def stream(data):
        return b"1 0 obj <</Filter /FlateDecode>>\nstream\n" + zlib.compress(data) + b"\nendstream endobj\n"

    pdf = b"%PDF-1.4\n" + stream(b"first text") + stream(b"\0" * 50_000) + stream(b"app.alert(1)") + b"%%EOF"
    df = spark.createDataFrame([("a", bytearray(pdf))], "file_id string, content binary")
    row = inflated_streams(df, max_total=10_000).first()
    assert row["bomb"] and row["inflated"] == "first text\napp.alert(1)"
    assert not inflated_streams(df).first()["bomb"]


def test_reachable_objects_equal_a_plain_search(spark):
    """A chain of 40 objects with a cycle, a fan, a file of no root and a reference out of nowhere."""
    from riskframe.operators.graph import reachable

    refs = [(1, i, i + 1) for i in range(40)] + [(1, 40, 7), (1, 90, 91)] + [(2, 0, k) for k in range(1, 200)] + [(2, 0, 5), (3, 0, 1)]
    roots = [(1, 0), (2, 0), (2, 0), (4, 9)]
    seen, todo = set(roots), list(roots)
    while todo:
        f, o = todo.pop()
        for new in {(f, t) for g, x, t in refs if (g, x) == (f, o)} - seen:
            seen.add(new)
            todo.append(new)
    got = reachable(spark.createDataFrame(roots, "file_id int, obj_key int"), spark.createDataFrame(refs, "file_id int, obj_key int, target int")).collect()
    assert sorted(map(tuple, got)) == sorted(seen)
