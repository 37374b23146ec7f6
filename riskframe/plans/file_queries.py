"""Queries over files, document features and installed apps."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.functions import fusion
from riskframe.operators import apps as ap
from riskframe.operators import files as fx
from riskframe.operators import graph as gr
from riskframe.plans.datasets import LINK_SQL, links, pick, table
from riskframe.plans.registry import query
from riskframe.plans.sqltext import ends_any, has_any, quoted

# -- PDF texts made from documents -----------------------------------------

# Structure, expected findings as (category, severity), hard trigger.
_PDF = [
    ("1 0 obj << /Type /Catalog /OpenAction 2 0 R >> endobj 2 0 obj << /S /GoTo >> endobj", [("AUTO_EXECUTE_ACTION", 3)], False),
    ("1 0 obj << /Type /Catalog /OpenAction 2 0 R >> endobj 2 0 obj << /S /JavaScript /JS 3 0 R >> endobj 3 0 obj << >> endobj",
     [("EMBEDDED_JAVASCRIPT", 8), ("EMBEDDED_JAVASCRIPT", 8), ("AUTO_EXECUTE_ACTION", 7)], True),
    ("1 0 obj << /Type /Catalog /Names 4 0 R >> endobj 4 0 obj << /Kids 5 0 R >> endobj 5 0 obj << /EmbeddedFiles (run.exe) >> endobj",
     [("EMBEDDED_EXECUTABLE", 8)], True),
    ("1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << >> endobj 9 0 obj << /EmbeddedFiles (run.exe) >> endobj",
     [("EMBEDDED_EXECUTABLE", 3)], False),
    ("1 0 obj << /Type /Catalog >> endobj", [], False),
    ("1 0 obj << /Type /Catalog /AA << /O 7 0 R >> >> endobj", [("AUTO_EXECUTE_ACTION", 3)], False),
    ("1 0 obj << /Type /Catalog /OpenAction << /S /Launch /F 2 0 R >> >> endobj", [("AUTO_EXECUTE_ACTION", 7), ("EMBEDDED_EXECUTABLE", 10)], True),
]
_PDF_TEXT = ("concat('%PDF-1.4 ', " + pick([t for t, _, _ in _PDF], "doc_id")
             + ", CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' %%EOF' END, ' % ', regexp_replace(text, '[^A-Za-z ]', ' '{g}))")


def _pdf_expected() -> str:
    rows = []
    for i, (_, found, hard) in enumerate(_PDF):
        total = sum(s for _, s in found) * 10
        rows.append(f"({i}, {len(found)}, {total}, {str(hard).lower()})")
    return ", ".join(rows)


def _pdf_files(spark, sf):
    body = table(spark, sf, "documents").selectExpr("doc_id", f"{_PDF_TEXT.format(g='')} AS raw")
    return body.select(
        F.col("doc_id").cast("string").alias("file_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"),
        F.encode("raw", "UTF-8").alias("content")).withColumn("size", F.length("content").cast("bigint"))


@query("pdf_scan", f"""
WITH e(k, n, total, hard) AS (VALUES {_pdf_expected()}),
d AS (SELECT doc_id, n + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n, hard, least(100, total + CASE WHEN doc_id % 5 = 0 THEN 50 ELSE 0 END) AS t
  FROM documents JOIN e ON k = doc_id % {len(_PDF)}),
s AS (SELECT *, CASE WHEN hard THEN greatest(t, 85) ELSE t END AS score FROM d)
SELECT CAST(doc_id AS VARCHAR) AS file_id, 'PDF' AS file_type, n AS n_findings, score AS structural_score, score AS threat_score,
  CASE WHEN score >= 60 THEN 'MALICIOUS' WHEN score >= 20 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict FROM s""")
def pdf_scan(spark, sf):
    return fx.scan_files(_pdf_files(spark, sf)).select(
        "file_id", "file_type", F.size("findings").alias("n_findings"), "structural_score", "threat_score", "verdict")


@query("finding_scores", f"""
WITH e(k, n, total, hard) AS (VALUES {_pdf_expected()})
SELECT CAST(doc_id AS VARCHAR) AS file_id, n + cut AS findings, hard AS hard_trigger,
  CASE WHEN hard THEN greatest(least(100, total + 50 * cut), 85) ELSE least(100, total + 50 * cut) END AS structural_score
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS cut FROM documents) JOIN e ON k = doc_id % {len(_PDF)} WHERE n + cut > 0""")
def finding_scores(spark, sf):
    return fx.structural_scores(fx.scan_files(_pdf_files(spark, sf)).select("file_id", F.inline("findings")))


@query("scan_reports")
def scan_reports(spark, sf):
    scanned = fx.scan_files(_pdf_files(spark, sf))
    round_trip = scanned.withColumn("findings", fx.findings_from_json(fx.findings_to_json(F.col("findings"))))
    return round_trip.select(
        "file_id", fx.plain_summary(F.col("verdict"), F.col("findings")).alias("plain_summary"),
        fx.technical_detail(round_trip).alias("technical_detail"))


@query("pdf_shape", f"""
SELECT CAST(doc_id AS VARCHAR) AS file_id, len(regexp_extract_all(r, '\\bstream\\b')) AS stream_count, contains(r, '/FlateDecode') AS has_flate,
  {" + ".join(f"CAST(contains(r, {quoted(m)}) AS INT)" for m in lx.PDF_VECTOR_MARKERS)} AS n_markers
FROM (SELECT doc_id, {_PDF_TEXT.format(g=", 'g'")} AS r FROM documents)""")
def pdf_shape(spark, sf):
    files = _pdf_files(spark, sf).withColumns({
        "raw": F.decode("content", "ISO-8859-1"), "entropy": F.lit(0.0), "findings": F.array().cast("array<struct<category:string,description:string,severity:int>>")})
    shaped = fx.pdf_vector(fx.pdf_shape(files))
    marks = F.aggregate(F.slice("features", 6, 16), F.lit(0.0), lambda a, x: a + x)
    return shaped.select("file_id", F.col("stream_count").cast("bigint").alias("stream_count"), "has_flate", marks.cast("int").alias("n_markers"))


@query("object_reachability", """
WITH RECURSIVE refs AS (SELECT DISTINCT l_orderkey AS file_id, l_linenumber AS obj_key, l_linenumber + 1 AS target FROM lineitem WHERE l_quantity > 10),
w(file_id, obj_key) AS (SELECT o_orderkey, 1 FROM orders UNION SELECT w.file_id, refs.target FROM w JOIN refs ON w.file_id = refs.file_id AND w.obj_key = refs.obj_key)
SELECT file_id, obj_key FROM w""")
def object_reachability(spark, sf):
    refs = table(spark, sf, "lineitem").filter("l_quantity > 10").select(
        F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("obj_key"), (F.col("l_linenumber") + 1).alias("target"))
    roots = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), F.lit(1).alias("obj_key"))
    return gr.reachable(roots, refs)


@query("file_types", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'PDF' WHEN 1 THEN 'OFFICE' WHEN 2 THEN 'PE' WHEN 3 THEN 'OFFICE' WHEN 4 THEN 'ARCHIVE' ELSE 'UNKNOWN' END AS file_type FROM part""")
def file_types(spark, sf):
    heads = F.array(*[F.unhex(F.lit(h)) for h in ("255044462D312E34", "D0CF11E0A1B11AE1", "4D5A9000", "504B030414", "504B0506", "48656C6C6F")])
    names = F.array(*[F.lit(n) for n in ("a.pdf", "b.doc", "c.exe", "d.docx", "e.zip", "f.txt")])
    at = (F.col("p_partkey") % 6 + 1).cast("int")
    df = table(spark, sf, "part").select("p_partkey", F.concat(F.element_at(heads, at), F.encode("p_name", "UTF-8")).alias("content"), F.element_at(names, at).alias("name"))
    return df.select("p_partkey", fx.file_type(F.col("content")).alias("file_type"))


# -- documents with macros -------------------------------------------------

def _occ(c: str, terms) -> str:
    return " + ".join(f"(len({c}) - len(replace({c}, {quoted(t)}, ''))) // {len(t)}" for t in terms)


_MACRO = " Sub AutoOpen() Shell \"powershell http://a.com/x\" End Sub "
_MSQL = f"(SELECT page_id, concat(html, CASE WHEN page_id % 4 = 0 THEN {quoted(_MACRO)} ELSE '' END) AS src FROM pages)"


@query("macro_features", f"""
WITH s AS (SELECT page_id, src, lower(src) AS low, concat(chr(10), lower(src)) AS every FROM {_MSQL})
SELECT page_id AS file_id, CAST({_occ('low', lx.AUTOEXEC_TERMS)} AS DOUBLE) AS "AUTOEXEC_TOTAL", CAST({_occ('low', lx.OBFUSCATION_TERMS)} AS DOUBLE) AS "OBFUSCATION_TOTAL",
  CAST({_occ('low', lx.EXECUTION_TERMS)} AS DOUBLE) AS "EXECUTION_TOTAL", CAST({_occ('every', lx.PAYLOAD_TERMS['SHELL_COUNT'])} AS DOUBLE) AS "SHELL_COUNT",
  CAST(len(regexp_extract_all(every, '(?i)https?://[^\\s"''<>]+')) AS DOUBLE) AS "URL_COUNT", CAST(len(regexp_extract_all(src, '"([^"]*)"')) AS DOUBLE) AS "STRING_LITERAL_COUNT",
  CAST({_occ('src', ['&'])} AS DOUBLE) AS "CONCAT_OPERATOR_COUNT", CAST({_occ('src', ['('])} + {_occ('src', [')'])} AS DOUBLE) AS "PARENTHESES_COUNT",
  CAST(len(src) AS DOUBLE) AS "SOURCE_LENGTH", CAST(({_occ('low', lx.AUTOEXEC_TERMS)}) > 0 AND ({_occ('every', lx.PAYLOAD_TERMS['SHELL_COUNT'])}) > 0 AS INT)::DOUBLE AS "AUTOEXEC_SHELL_COMBINATION"
FROM s""")
def macro_features(spark, sf):
    src = F.concat("html", F.when(F.col("page_id") % 4 == 0, F.lit(_MACRO)).otherwise(""))
    df = table(spark, sf, "pages").select(
        F.col("page_id").alias("file_id"), src.alias("source"), F.lit("").alias("bytes_text"), F.length("html").cast("bigint").alias("size"),
        F.lit(5.0).alias("entropy"), F.lit(False).alias("is_ole"), F.lit(True).alias("is_ooxml"), F.lit(1).alias("module_count"), F.lit(3).alias("vba_lines"))
    return fx.macro_features(df).select(
        "file_id", "AUTOEXEC_TOTAL", "OBFUSCATION_TOTAL", "EXECUTION_TOTAL", "SHELL_COUNT", "URL_COUNT", "STRING_LITERAL_COUNT",
        "CONCAT_OPERATOR_COUNT", "PARENTHESES_COUNT", "SOURCE_LENGTH", "AUTOEXEC_SHELL_COMBINATION")


_PARTS = ["_rels/.rels", "word/embeddings/x.bin", "word/media/i.png", "word/activex/a.xml", "xl/externallinks/l.xml", "word/vbaproject.bin",
          "customxml/item.xml", "word/attachedtemplate.xml", "word/document.xml"]


@query("ooxml_features", f"""
WITH p AS (SELECT l_orderkey AS file_id, {pick(_PARTS, 'l_partkey')} AS n, CASE WHEN l_suppkey % 3 = 0 THEN 'targetmode="external" attachedtemplate' ELSE '' END AS b FROM lineitem)
SELECT file_id, count_if(ends_with(n, '.rels'))::DOUBLE AS "RELATIONSHIP_COUNT", count_if(ends_with(n, '.rels') AND contains(b, 'external'))::DOUBLE AS "EXTERNAL_RELATIONSHIP_COUNT",
  count_if(contains(n, '/embeddings/'))::DOUBLE AS "EMBEDDED_OBJECT_COUNT", count_if(contains(n, '/media/') OR contains(n, '/embeddings/'))::DOUBLE AS "EMBEDDED_FILE_COUNT",
  count_if(contains(n, 'activex'))::DOUBLE AS "ACTIVEX_COUNT", count_if(contains(n, 'externallinks'))::DOUBLE AS "EXTERNAL_LINK_COUNT",
  sum(CASE WHEN contains(n, 'attachedtemplate') THEN 1 ELSE 0 END + CASE WHEN ends_with(n, '.rels') AND b <> '' THEN 1 ELSE 0 END)::DOUBLE AS "REMOTE_TEMPLATE_COUNT",
  count_if(contains(n, 'customxml'))::DOUBLE AS "CUSTOM_XML_COUNT", max(CASE WHEN contains(n, 'vbaproject.bin') THEN 1 ELSE 0 END)::DOUBLE AS "VBA_PROJECT_PRESENT" FROM p GROUP BY 1""")
def ooxml_features(spark, sf):
    parts = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS file_id", f"{pick(_PARTS, 'l_partkey')} AS part_name",
        "CASE WHEN l_suppkey % 3 = 0 THEN 'targetmode=\"external\" attachedtemplate' ELSE '' END AS part_text")
    return fx.ooxml_features(parts)


_STREAMS = ["ObjectPool/x", "Root/Contents", "WordDocument", "Data\\\\embedded"]
_TAILS = ["/run.exe?x=1", "/setup.application", "/readme.txt", "/a.application?y", ""]
_DANGER = ends_any("split_part(split_part(lower(u), '?', 1), '#', 1)", lx.DANGEROUS_TARGET_EXTENSIONS)


@query("stream_url_evidence", f"""
WITH l AS (SELECT link_id % 1000000000 AS file_id, link_id, concat(url, {pick(_TAILS, 'link_id')}) AS u0 FROM ({LINK_SQL}) WHERE starts_with(url, 'http')),
u AS (SELECT file_id, link_id % 4 IN (0, 1, 3) AS sec, rtrim(regexp_extract(u0, '(?i)https?://[^\\s<>''"\\\\]+'), '.,;:)]}}>') AS u FROM l)
SELECT file_id, count(*) AS valid_urls, count_if({_DANGER}) AS dangerous_targets, count_if(sec) AS security_stream_urls,
  count_if(ends_with(split_part(lower(u), '?', 1), '.application') AND ({_DANGER} OR sec)) AS application_urls FROM u GROUP BY 1""")
def stream_url_evidence(spark, sf):
    strings = links(spark, sf).filter("url like 'http%'").selectExpr(
        "link_id % 1000000000 AS file_id", f"{pick(_STREAMS, 'link_id')} AS stream", f"concat(url, {pick(_TAILS, 'link_id')}) AS text")
    return fx.url_evidence(fx.stream_urls(strings))


# -- malware aggregation ---------------------------------------------------

_PRED = ["MALICIOUS", "BENIGN", "SUSPICIOUS", "SAFE", "REQUIRES_EXTRACTION", "UNSUPPORTED", "UNKNOWN"]


@query("malware_risk", f"""
WITH i AS (SELECT p_partkey, {pick(_PRED, 'p_partkey')} AS p, CAST(p_partkey * 13 % 101 AS DOUBLE) / 100 AS s, p_partkey % 3 AS a, p_partkey % 5 AS b, p_partkey % 7 AS c, p_partkey % 2 AS d FROM part),
m AS (SELECT *, CASE p WHEN 'MALICIOUS' THEN greatest(s * 100, 75) WHEN 'SUSPICIOUS' THEN greatest(s * 100, 50) WHEN 'REQUIRES_EXTRACTION' THEN greatest(s * 100, 35)
  WHEN 'UNSUPPORTED' THEN greatest(s * 100, 20) ELSE s * 100 END AS base FROM i),
r AS (SELECT *, round(least(100, greatest(0, base + CASE WHEN a > 0 THEN 30 ELSE 0 END + CASE WHEN b > 0 THEN 20 ELSE 0 END + CASE WHEN c = 1 THEN 25 ELSE 0 END
  + CASE WHEN d = 1 THEN 10 ELSE 0 END + CASE WHEN c = 2 THEN 20 ELSE 0 END)), 2) AS risk_score,
  1 + CAST(a > 0 AS INT) + CAST(b > 0 AS INT) + CAST(c = 1 AS INT) + CAST(d = 1 AS INT) + CAST(c = 2 AS INT) AS n_reasons FROM m),
v AS (SELECT *, CASE WHEN p = 'MALICIOUS' OR risk_score >= 80 THEN 'MALICIOUS' WHEN p IN ('SUSPICIOUS','REQUIRES_EXTRACTION','UNSUPPORTED') OR risk_score >= 40 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS final_verdict FROM r)
SELECT p_partkey, risk_score, final_verdict, CASE WHEN p = 'MALICIOUS' THEN CASE WHEN s >= 0.8 THEN 'HIGH' ELSE 'MEDIUM' END
  WHEN p IN ('BENIGN','SAFE') AND final_verdict = 'SAFE' AND s <= 0.30 THEN 'HIGH' WHEN final_verdict = 'MALICIOUS' THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, n_reasons FROM v""")
def malware_risk(spark, sf):
    df = table(spark, sf, "part").selectExpr(
        "p_partkey", f"{pick(_PRED, 'p_partkey')} AS prediction", "CAST(p_partkey * 13 % 101 AS DOUBLE) / 100 AS score",
        "p_partkey % 3 AS dangerous_targets", "p_partkey % 5 AS security_stream_urls", "CASE WHEN p_partkey % 7 = 1 THEN 2 ELSE 0 END AS application_urls",
        "0 AS external_urls", "CASE WHEN p_partkey % 2 = 1 THEN 'detected' ELSE 'absent' END AS high_entropy",
        "p_partkey % 7 = 2 AS network_execution", "false AS obfuscation_execution", "false AS vba_autoexec", "false AS vba_network")
    return fusion.malware_risk(df).select("p_partkey", "risk_score", "final_verdict", "confidence", F.size("reasons").alias("n_reasons"))


# -- apps ------------------------------------------------------------------

_PACKAGES = ["com.sbi.lotusintouch", "com.example.game", "com.whatsapp", "com.phonepe.app", "org.tool.one", "com.fake.hdfc"]
_PERMS = {"RECEIVE_SMS": "c_custkey % 2 = 0", "READ_SMS": "c_custkey % 3 = 0", "SYSTEM_ALERT_WINDOW": "c_custkey % 5 = 0", "BIND_ACCESSIBILITY_SERVICE": "c_custkey % 7 = 0"}


def _apps(spark, sf):
    perms = ", ".join(f"CASE WHEN {c} THEN 'android.permission.{p}' END" for p, c in _PERMS.items())
    certs = dict(lx.BANK_CERTIFICATES)
    return table(spark, sf, "customer").selectExpr(
        "c_custkey", f"{pick(_PACKAGES, 'c_custkey')} AS package", "c_name AS label",
        "CASE WHEN c_custkey % 4 = 0 THEN 'com.android.vending' END AS installer", f"array_compact(array({perms})) AS permissions",
        "c_custkey % 11 = 0 AS accessibility_active",
        f"CASE WHEN c_custkey % 13 = 0 THEN 'AA' WHEN c_custkey % 6 = 0 THEN '{certs['com.sbi.lotusintouch']}' WHEN c_custkey % 6 = 3 THEN '{certs['com.phonepe.app']}' END AS cert_sha256",
        "c_custkey % 17 = 0 AS system")


@query("app_risk", f"""
WITH a AS (SELECT c_custkey, {pick(_PACKAGES, 'c_custkey')} AS package, c_custkey % 4 = 0 AS store, c_custkey % 11 = 0 AS active, c_custkey % 13 = 0 AS badcert, c_custkey % 6 AS k,
  CAST(c_custkey % 2 = 0 AS INT) + CAST(c_custkey % 3 = 0 AS INT) + CAST(c_custkey % 5 = 0 AS INT) + CAST(c_custkey % 11 = 0 OR c_custkey % 7 = 0 AS INT) AS n FROM customer WHERE c_custkey % 17 <> 0),
b AS (SELECT *, {has_any('lower(package)', lx.BANK_KEYWORDS)} AS bank, badcert AND k IN (0, 3) AS mismatch, package = 'com.whatsapp' AS allow FROM a),
s AS (SELECT *, least(100, greatest(0, CASE WHEN mismatch THEN 100 WHEN bank AND NOT store THEN 95 WHEN n >= 4 THEN 85 WHEN n = 3 THEN 65 WHEN n = 2 THEN 45 WHEN n = 1 THEN 20 ELSE 0 END
  + CASE WHEN active THEN 15 ELSE 0 END + CASE WHEN NOT store AND NOT bank THEN 15 ELSE 0 END - CASE WHEN allow AND store THEN 30 ELSE 0 END)) AS risk_score FROM b WHERE n > 0 OR NOT store OR bank)
SELECT c_custkey, package, n AS combo_count, risk_score, CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'SAFE' END AS risk_level,
  risk_score >= 60 AND NOT allow AS should_alert FROM s WHERE risk_score >= 40 OR bank""")
def app_risk(spark, sf):
    return ap.app_risk(_apps(spark, sf)).select("c_custkey", "package", "combo_count", "risk_score", "risk_level", "should_alert")


@query("package_vectors", """
SELECT c_custkey, CAST(CAST(c_custkey % 2 = 0 AS INT) + CAST(c_custkey % 3 = 0 AS INT) + 2 * CAST(c_custkey % 5 = 0 AS INT) + 2 * CAST(c_custkey % 7 = 0 AS INT) AS DOUBLE) AS ones,
  CASE WHEN c_custkey % 5 = 0 THEN 0.25 ELSE 0.0 END AS fallback_score, 64 AS width FROM customer""")
def package_vectors(spark, sf):
    v = _apps(spark, sf).select("c_custkey", fx.package_vector(F.col("permissions")).alias("v"), fx.package_fallback(F.col("permissions")).alias("fallback_score"))
    ones = F.aggregate(F.slice("v", 1, 54), F.lit(0.0), lambda a, x: a + x)
    return v.select("c_custkey", ones.alias("ones"), "fallback_score", F.size("v").alias("width"))
