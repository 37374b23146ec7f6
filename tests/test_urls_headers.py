import ipaddress
import random

from pyspark.sql import functions as F

from riskframe.functions import headers as hx
from riskframe.functions import urls as ux
from riskframe.operators import enrichment as en


def test_brand_imitation_cases(one):
    kind = lambda d: (one(ux.brand_imitation("t"), t=d) or {"type": None})["type"]
    assert kind("microsoft-support.com") == "COMBOSQUAT"
    assert kind("paypa1.com") == "TYPOSQUAT"
    assert kind("paypal.com.attacker.net") == "SUBDOMAIN_SPOOF"
    assert kind("mail.google.com") is None and kind("example.org") is None and kind("localhost") is None


def test_mobile_domain_rules(spark):
    cases = {
        "google.com": (False, False), "mail.google.com": (False, False), "sbi.co.in": (False, False),
        "gooogle.com": (True, None), "paypa1.com": (True, None), "paypal.com.attacker.xyz": (True, None),
        "xn--pple-43d.com": (None, True), "github.com": (False, False)}
    df = en.decode_hosts(spark.createDataFrame([(h,) for h in cases], "host string"))
    got = {r["host"]: r["s"] for r in df.select("host", ux.domain_spoof("host", F.col("unicode_host")).alias("s")).collect()}
    for host, (typo, homo) in cases.items():
        if typo is not None:
            assert got[host]["typosquat"] == typo, host
        if homo is not None:
            assert got[host]["homograph"] == homo, host


def test_url_risk_order(one):
    risk = lambda u: one(ux.url_assessment("t")["risk_score"], t=u)
    assert [risk(u) for u in (
        "javascript:alert(1)", "http://paypa1.com/x", "http://10.0.0.1/", "https://bit.ly/x", "http://shop.xyz/", "http://unknown.org/",
        "https://www.google.com/")] == [95, 90, 90, 75, 70, 25, 0]


def test_lexical_features(spark):
    f = ux.lexical_features("u")
    row = spark.createDataFrame([("https://secure-login-paypal.com.xyz/update?id=123",)], "u string").select(
        *[c.alias(n) for n, c in f.items()]).first()
    assert len(f) == 29
    assert (row["url_length"], row["count_hyphens"], row["is_suspicious_tld"], row["has_brand_name"], row["count_digits"]) == (49, 2, 1, 1, 3)
    assert one_entropy(row["domain_entropy"], "secure-login-paypal.com.xyz")


def one_entropy(value, text):
    import math
    from collections import Counter
    n = len(text)
    return abs(value + sum(c / n * math.log2(c / n) for c in Counter(text).values())) < 1e-9


def _reference_class(ip):
    try:
        a = ipaddress.ip_address(ip)
    except ValueError:
        return "INVALID"
    for name, test in (("LOOPBACK", a.is_loopback), ("LINK_LOCAL", a.is_link_local), ("PRIVATE", a.is_private),
                       ("RESERVED", a.is_reserved or a.is_multicast or a.is_unspecified), ("PUBLIC", a.is_global)):
        if test:
            return name
    return "RESERVED"


def test_ip_classes_match_the_standard_library(spark):
    rng = random.Random(7)
    ips = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(400)]
    ips += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(200)]
    for net in ("fe80::/10", "fc00::/7", "2001::/23", "2001:db8::/32", "2002::/16", "ff00::/8", "64:ff9b:1::/48", "100::/64", "::ffff:0:0/96", "2000::/3", "3fff::/20"):
        n = ipaddress.ip_network(net)
        ips += [str(n[rng.randrange(min(n.num_addresses, 1 << 60))]) for _ in range(10)]
    ips += ["::1", "::", "1:2:3", "::ffff:8.8.8.8", "2607:f8b0:4005:805::200e", "12:00", ":::", "1::2::3", "256.1.1.1", "01.2.3.4",
            "192.0.0.9", "192.0.0.170", "100.64.0.1", "224.0.0.1", "255.255.255.255", "2001:4:112::1", "2001:20::1", "abc", "1:2:3:4:5:6:7:8:9"]
    got = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", hx.ip_class("ip").alias("c")).collect()
    wrong = [(r["ip"], r["c"], _reference_class(r["ip"])) for r in got if r["c"] != _reference_class(r["ip"])]
    assert not wrong


HOPS = ["from mx (1.2.3.4) by google.com; Mon 12:00:01", "from b ([142.250.190.46]) by mail.isp.net; x", "from c ([10.0.0.5]) by relay; x"]


def test_relay_chain(spark):
    df = spark.createDataFrame([(1, HOPS, {}), (2, ["from l ([127.0.0.1]) by a", "from m ([192.168.0.2]) by b"], {}),
                                (3, [], {"x-originating-ip": "[8.8.4.4]"})],
                               "email_id int, received_headers array<string>, raw_headers map<string,string>")
    hops = en.relay_hops(df).filter("email_id = 1").orderBy("hop_index").collect()
    assert [h["ip"] for h in hops] == ["10.0.0.5", "142.250.190.46", "1.2.3.4"]
    assert [h["trust_label"] for h in hops] == ["SUSPICIOUS_RELAY", "OBSERVED", "TRUSTED_RELAY"]
    o = {r["email_id"]: r["o"] for r in df.select("email_id", en.origin_ip(
        en.hop_array("received_headers"), F.col("received_headers"), F.col("raw_headers")).alias("o")).collect()}
    assert o[1]["ip"] == "142.250.190.46" and o[2]["ip"] == en.NOT_DETERMINABLE and o[3]["ip"] == "8.8.4.4"
    seen = [r["ip"] for r in en.observed_ips(df).filter("email_id = 1").orderBy("sighting").collect()]
    assert seen == ["10.0.0.5", "142.250.190.46", "1.2.3.4"]


def test_ipv6_relay_literal_is_whole(spark):
    df = spark.createDataFrame([(1, ["from x (IPv6:2607:f8b0:4005:805::200e) by y; Mon, 1 Jan 2024 12:00:00"])], "email_id int, received_headers array<string>")
    ip = en.relay_hops(df).first()["ip"]
    assert ip is None or ip.startswith("2607:") and ip.endswith("200e")
    df = spark.createDataFrame([(1, ["from x ([2607:f8b0:4005:805::200e]) by y; Mon, 1 Jan 2024 12:00:00"])], "email_id int, received_headers array<string>")
    assert en.relay_hops(df).first()["ip"] == "2607:f8b0:4005:805::200e"


def test_authentication(one):
    a = one(hx.parse_auth("t"), t="mx; spf=pass (ok) x; dkim=pass header.d=a; dmarc=bestguesspass")
    assert (a["spf"], a["dkim"], a["dmarc"], a["authorization"]) == ("PASS", "PASS", "PASS", "DOMAIN_AUTHORIZED")
    assert one(hx.parse_auth("t"), t="spf=softfail; dkim=none")["authorization"] == "PARTIAL_OR_UNAVAILABLE"
    assert one(hx.parse_auth("t"), t="dkim=fail")["authorization"] == "DOMAIN_UNAUTHORIZED"
    assert one(hx.auth_score(hx.parse_auth("t")), t="spf=softfail; dkim=none; dmarc=fail") == 25 + 10 + 33
    assert one(hx.auth_score(hx.parse_auth("t")), t="") == 0


def test_header_block(one):
    raw = "From: Google Security <attacker@evil.com>\r\nReply-To: x@other.com\nSubject: a\n\tb\nReceived: from p ([8.8.8.8])\nReceived: from q ([1.1.1.1])\nAuthentication-Results: spf=fail"
    h = one(hx.mobile_headers("t"), t=raw)
    assert (h["spf"], h["originating_ip"], h["hop_count"], h["relay_suspicious"], h["reply_mismatch"]) == ("FAIL", "8.8.8.8", 2, True, True)
    assert one(hx.header_map("t")["subject"], t=raw) == "a b"
    assert one(ux.display_spoof("t"), t="Google Security <attacker@evil.com>") == "google"


def test_spoofed_senders(one):
    s = one(ux.spoof_check("s", "r", "p"), s="PayPal <help@evil.com>", r="x@other.com", p="")
    assert s["score"] == 75 and s["header_mismatch"] and s["impersonating"]
    assert one(ux.spoof_check("s", "r", "p"), s="a@paypa1.com", r="", p="")["score"] == 85
    assert one(ux.spoof_check("s", "r", "p"), s="a@corp.com", r="", p="")["score"] == 0


def test_enrichment_keeps_unknown_ages_unknown(spark):
    dim = spark.createDataFrame([("a.com", None, None, True), ("b.com", "R", "2024-05-25", False)], "domain string, registrar string, creation_date string, has_mx boolean")
    dim = dim.withColumn("creation_date", F.to_date("creation_date"))
    mails = spark.createDataFrame([(1, "x@a.com"), (2, "x@b.com"), (3, "x@c.com")], "id int, sender string")
    out = {r["id"]: r for r in en.enrich_domains(mails, dim, F.to_date(F.lit("2024-06-01"))).collect()}
    assert out[1]["age_days"] is None and not out[1]["is_young_domain"]
    assert out[2]["age_days"] == 7 and out[2]["is_young_domain"] and out[3]["domain_status"] is None


def test_known_bad_hash_ignores_the_empty_digest(spark):
    from riskframe import lexicons as lx
    att = spark.createDataFrame([(1, lx.EMPTY_SHA256), (2, "AB" * 32)], "id int, sha256 string")
    bad = spark.createDataFrame([(lx.EMPTY_SHA256,), ("ab" * 32,)], "sha256 string")
    assert [r["id"] for r in en.known_bad_attachments(att, bad).collect()] == [2]


def test_hosts_of_odd_urls(one):
    from riskframe.functions.common import host_of, path_of, query_of
    from pyspark.sql import functions as F

    cases = {
        "http://paypa1.com/a|b": "paypa1.com", "http://paypa1.com/a{b}?q=%zz": "paypa1.com", "http://pay_pal-login.com/x": "pay_pal-login.com",
        "http://аpple.com/x": "аpple.com", "HTTPS://User:p@ss@Example.COM:8080/x": "example.com", "http://[2001:DB8::1]:80/": "2001:db8::1",
        "//cdn.example.net/x": "cdn.example.net", "mailto:a@b.c": "", "no url": "", "": "", " http://lead.com": "lead.com", "http://x.com?q@y.com": "x.com",
    }
    for url, host in cases.items():
        assert one(host_of(F.col("u")), u=url) == host, url
    assert one(path_of(F.col("u")), u="http://x.com/a|b/c?d#e") == "/a|b/c" and one(query_of(F.col("u")), u="http://x.com/a?d=%zz#e") == "d=%zz"
    assert one(path_of(F.col("u")), u="javascript:alert/1") == ""


def test_sql_ip_class_equals_the_column_rule(spark):
    from pyspark.sql import functions as F

    from riskframe.functions.headers import ip_class
    from riskframe.functions.sql import register_functions

    register_functions(spark)
    values = ["8.8.8.8", "10.0.0.1", "1.2.3", "127.0.0.1", "169.254.1.1", "::1", "::", "fe80::1", "2001:db8::1", "2a00:1450:4009::8a", "fd12:3456::1",
              "::ffff:10.0.0.1", "::ffff:8.8.8.8", "1:2:3:4:5:6:7:8", "1:2", "g::1", "::1.2.3.4", " 8.8.4.4 ", "", None, "2002:aabb::", "ff02::1"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select("v", ip_class("v").alias("a"), F.expr("ip_class(v)").alias("b")).collect()
    assert [(r["v"], r["a"]) for r in rows] == [(r["v"], r["b"]) for r in rows]


def test_an_idn_link_is_decoded_before_it_is_judged(spark):
    from riskframe.operators.enrichment import spoofed_links

    rows = [(1, ["http://xn--pypal-4ve.com/login"]), (2, ["https://www.paypal.com/", "http://paypa1.com/x"]), (3, ["https://example.org/"]), (4, [])]
    got = spoofed_links(spark.createDataFrame(rows, "email_id int, urls array<string>"), "email_id").collect()
    assert {r["email_id"]: (r["typosquat"], r["homograph"]) for r in got} == {1: (got[0]["typosquat"] if got[0]["email_id"] == 1 else next(
        r["typosquat"] for r in got if r["email_id"] == 1), True), 2: (True, False), 3: (False, False), 4: (False, False)}
